"""License scans: ordered signature rules, gated by keywords, with suppression of contained detections.

SQL functions only. The rules (``license_rules``) are some three hundred regular expressions written by
hand. A text with none of their keywords is passed over; of any other the words are brought together
with single spaces, and a rule is looked for only where its keyword occurs. Each rule has a priority; a
detection that lies within another of the same or a higher priority is dropped.

Defined results: null text counts as empty (no words, no labels, score 0); repeated rows each get a
row; a null ``doc_id`` stays null; an empty table gives no rows; extra columns pass through ``scan``
unless named like a result, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.license_rules import ROWS
from cadenza.llm.session import free_name, table
from cadenza.llm.spans import find_all, let

# Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
SHORT = 3  # keywords of no more letters must begin a word


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules in order."""
    return [Rule(label, keyword, pattern, int(priority), float(confidence)) for label, keyword, priority, confidence, pattern in ROWS]


_BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def gate_word(rule: Rule) -> str:
    """What the texts of a rule have in common that is rarest: "licen" where the pattern always has it, else the keyword."""
    depth, kept = 0, ""
    for c in rule.pattern:
        depth += (c == "(") - (c == ")")
        kept += c if depth == 0 else "|"
    return "licen" if "licen" in kept else rule.keyword


def gate(text: Column, table_: list[Rule]) -> Column:
    """Whether the gate word of any rule, or of the base phrases, occurs in a text as it is: necessary for any detection.

    A keyword lies within one word, so how words are set apart does not matter.
    """
    keywords = sorted({gate_word(r) for r in table_} | {"licen", "cc"})
    long_ = F.array(*(F.lit(k) for k in keywords if len(k) > SHORT))
    short = "|".join(k for k in keywords if len(k) <= SHORT)
    return let(F.lower(text), lambda low: low.rlike(f"(?<![0-9a-z\\x80-\\uFFFF])(?:{short})") | F.exists(long_, lambda k: F.contains(low, k)))


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters and everything beyond ASCII."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda w: w != "")


def detections(joined: Column, table_: list[Rule]) -> Column:
    """Detections s, e, priority, label, confidence in single-spaced words, before suppression, in order of place."""
    literal = F.array(*(F.struct(F.lit(r.keyword if len(r.keyword) > SHORT else f" {r.keyword}").alias("keyword"), F.lit(f"(?i)(?<= )(?:{r.pattern})(?= )").alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence")) for r in table_))

    def of(text: Column) -> Column:
        low = F.lower(text)
        gated = let(low, lambda t: F.filter(literal, lambda r: F.contains(t, r["keyword"])))
        found = F.flatten(F.transform(gated, lambda r: F.transform(find_all(text, r["pattern"]), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("to"), (-r["priority"]).alias("rank"), r["label"].alias("label"), r["confidence"].alias("confidence")))))
        return F.array_sort(found)

    return let(joined, of)


def surviving(found: Column, levels: int = 4) -> Column:
    """Labels and the best confidence of detections that no other of the same or a higher priority contains.

    ``found`` is sorted by start, then longest first: a container always comes before what it
    contains, so the furthest end so far of each priority decides.
    """

    def step(acc: Column, d: Column) -> Column:
        own = -d["rank"]
        reach = F.array_max(F.slice(acc["ends"], own, levels + 1 - own))
        inside = reach >= -d["to"]
        ends = F.transform(acc["ends"], lambda e, i: F.when(i + 1 == own, F.greatest(e, -d["to"])).otherwise(e))
        labels = F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"])))
        best = F.when(inside, acc["best"]).otherwise(F.greatest(acc["best"], d["confidence"]))
        return F.struct(ends.alias("ends"), labels.alias("labels"), best.alias("best"))

    zero = F.struct(F.array(*[F.lit(-1)] * levels).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"))
    return F.aggregate(found, zero, step)


def scan(docs: DataFrame, table_: list[Rule] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    table_ = rules() if table_ is None else table_
    words, joined, n, pieces, found = (free_name(docs.columns, c) for c in ("scan_words", "scan_joined", "scan_n", "scan_pieces", "scan_found"))
    admitted = F.coalesce(gate(F.col("text"), table_), F.lit(False))
    rows = docs.withColumn(words, words_of(F.col("text"))).withColumn(joined, F.when(admitted, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))))
    phrases = "|".join(p for p, _ in BASE)
    count = lambda piece: F.size(F.filter(F.split(piece, " "), lambda w: w != ""))
    rows = rows.withColumn(n, F.size(words).cast("long")).drop(words)
    rows = rows.withColumn(pieces, F.when(F.col(joined).rlike(f"(?i) (?:{phrases}) "), F.split(joined, f"(?i) (?=(?:{phrases}) )", -1)))
    rows = rows.withColumn(found, F.when(F.col(joined).isNotNull(), surviving(detections(F.col(joined), table_))))
    has = F.col(pieces).isNotNull()
    base = F.array_compact(F.array(*(F.when(F.col(joined).rlike(f"(?i) {p} "), F.lit(label)) for p, label in BASE)))
    base = F.when(has, F.array_sort(base)).otherwise(F.array().cast("array<string>"))
    labels = F.array_sort(F.array_union(base, F.coalesce(F.col(f"{found}.labels"), F.array().cast("array<string>"))))
    sure = F.greatest(F.when(F.size(base) > 0, 0.8).otherwise(0.0), F.coalesce(F.col(f"{found}.best"), F.lit(0.0)))
    out = {
        "n_words": F.col(n),
        "n_base": F.when(has, F.size(pieces) - 1).otherwise(0).cast("long"),
        "first_word": F.when(has, count(F.get(pieces, F.lit(0)))).cast("long"),
        "last_word": F.when(has, F.col(n) - count(F.element_at(pieces, -1))).cast("long"),
        "base_labels": F.array_join(base, ","),
        "labels": F.array_join(labels, ","),
        "score": sure,
    }
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in out), *(c.alias(name) for name, c in out.items()))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")

"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

SQL functions only. Every pattern is written so that it runs in linear time on any text: a match
begins at the start of a run of its characters or where the last match ended.

Defined results: null text counts as empty (no spans); repeated rows each get a row; a null
``doc_id`` stays null; an empty table gives no rows; extra columns are ignored by the query and pass
through ``personal_data`` unless named like a result (``pii_<kind>``), which replaces them. Spans of one
kind never overlap; spans of different kinds may.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.session import table
from cadenza.llm.spans import find_all, let

CONTEXT = 40  # code points before a span that are searched for context words


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str  # a necessary condition, cheap to test on the whole text
    pattern: str
    score: float
    words: str  # context words that raise the score
    base: bool = True


_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# The kinds in the order of the result, their patterns and context words.
KINDS = (
    Kind("email", "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write|reach"),
    Kind("ip", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address|login"),
    Kind("card", r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|credit|payment|account"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.8, "iban|bank|account|transfer", False),
    Kind("ssn", r"[0-9]-[0-9]", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.5, "ssn|social|security", False),
    Kind("secret", r"(?i)key|token|secret|passw|AKIA|\b(?:sk|ghp|xoxb)[-_]", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:[^-]*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----)?|\bAKIA[0-9A-Z]{16}\b|\b(?:sk|ghp|xoxb)[-_][A-Za-z0-9_-]{16,}+|(?i:\b(?:api[_-]?key|secret|token|passw(?:or)?d)\b\x20?[:=]\x20?[^\s,;]{6,}+)", 0.7, "key|token|secret|password", False),
)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` pass the Luhn check."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            x = F.ascii(F.substring(d, F.length(d) - i, F.lit(1))) - 48
            y = F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
            return acc + y

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)

    return let(digits(text), lambda d: (F.length(d) > 0) & (total(d) % 10 == 0))


def mod97(text: Column) -> Column:
    """Whether ``text``, read as an international account number, leaves 1 modulo 97."""
    plain = F.regexp_replace(text, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c == "", acc).when(code <= 57, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def confirmed(kind: Kind, m: Column) -> Column:
    """Whether a match of a kind's pattern holds up."""
    n = F.length(digits(m))
    if kind.name == "ip":
        return m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind.name == "card":
        return n.between(16, 19) & luhn(m)
    if kind.name == "phone":
        return n.between(8, 15)
    if kind.name == "iban":
        return mod97(m)
    return F.lit(True)


def spans(text: Column, kind: Kind, context: int = CONTEXT) -> Column:
    """Confirmed spans of a kind as structs kind, s, e, score; a context word shortly before a span adds 0.2."""
    found = F.filter(find_all(text, F.lit(kind.pattern), context), lambda x: confirmed(kind, x["m"]))

    def scored(x: Column) -> Column:
        near = x["before"].rlike(rf"(?i)\b(?:{kind.words})")
        return F.struct(F.lit(kind.name).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.when(near, kind.score + 0.2).otherwise(kind.score).alias("score"))

    none = F.array().cast("array<struct<kind:string,s:int,e:int,score:double>>")
    return F.when(text.rlike(kind.hint), F.transform(found, scored)).otherwise(none)


def personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with an array column of confirmed spans for each kind (``pii_<kind>``)."""
    text = F.coalesce("text", F.lit(""))
    taken = {f"pii_{k.name}" for k in kinds}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken), *(spans(text, k).alias(f"pii_{k.name}") for k in kinds))


def redact(docs: DataFrame, column: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with every match of a confirmed kind in ``column`` replaced by its kind in brackets, kinds in order.

    Kinds are taken one after the other, so a span of a later kind within an earlier one is gone with it.
    The pieces between the matches and the matches, confirmed or not, are joined again.
    """

    def of(text: Column, kind: Kind) -> Column:
        pattern = F.lit(kind.pattern)

        def joined(p: Column) -> Column:
            said = F.transform(p["m"], lambda m: F.when(confirmed(kind, m), F.lit(f"[{kind.name}]")).otherwise(m))
            # one piece more than matches
            return F.array_join(F.zip_with(p["gap"], said, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")

        return F.when(text.rlike(kind.hint), let(F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m")), joined)).otherwise(text)

    for kind in kinds:
        docs = docs.withColumn(column, of(F.col(column), kind))
    return docs


def _listed(columns: list[str]) -> Column:
    each = lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.concat(*(F.transform(c, each) for c in columns)), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = personal_data(docs).drop("text")
    base, every = [f"pii_{k.name}" for k in KINDS if k.base], [f"pii_{k.name}" for k in KINDS]
    counts = [F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    highest = F.coalesce(F.array_max(F.transform(F.concat(*every), lambda x: x["score"])), F.lit(0.0))
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"), highest.alias("score"))

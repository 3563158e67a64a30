"""Conversation structure repair: faults by windows, cheapest repair by a higher-order fold, in SQL functions only.

A conversation is the rows of one ``conv_id`` in the order of ``turn`` (nulls first; rows of one turn
by role, then text). Null role and text count as one space. A row's first fault counts: blank, a
duplicate of an earlier row, truncated. A repair makes the initials of the roles ``(s?(ua)+)?`` by
edits: (K)eep costs 0, (R)erole to user or assistant 2, (D)elete 3, (I)nsert an empty user or
assistant row 2; blank rows and duplicates must go, and a truncated row that stays adds 1.

``aggregate()`` folds the rows through four states: nothing yet, a system row alone, after a user
row, after an assistant row. Each holds the cheapest edits that lead there as a struct (cost, audit),
and ``least`` chooses by cost and then by audit. That is exact: of two audits for the same rows and
state neither is the beginning of the other at equal cost, as what follows could be insertions only.
Within the fold a letter also tells the role that it gives (``I``/``J`` insert and ``R``/``S`` rerole
to user/assistant); a role follows from the audit before it, so this never changes an order. Audits
grow with every step, so rows are folded in blocks of ``BLOCK`` from each of the four states, and the
blocks' tables are put together: a conversation of n rows costs n * BLOCK and not n * n.

Defined results: rows without ``conv_id`` are one conversation; a conversation whose rows are all
dropped has zeros and no edits; any role has its first character as initial, and an empty one none;
repeated rows are duplicates; an empty table gives no rows; extra columns are ignored. The repaired
text of a conversation is one value, as its hash needs it, so a conversation meets in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.session import table
from cadenza.llm.spans import let

BLOCK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_STATES = ("e", "s", "u", "a")  # nothing yet, system, user, assistant
_FAR = 1 << 40  # the cost of what cannot be reached


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with nulls as one space, damaged by the crc32 of ``conv_id:turn``: (conv_id, turn, role, text); ``copy`` is null for a dropped row."""
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, F.array().cast("array<int>")).when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return plain.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode_outer(copies).alias("copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault, clash, place): each row's first fault, whether it and the one before clash, and its place.

    ``fault`` is ``b``, ``d``, ``t`` or empty. All windows share one shuffle by conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(order), initial)
    placed = rows.select("conv_id", "turn", "role", "text", pair.alias("pair"), F.row_number().over(order).alias("place"))
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = F.when(last == "", "b").when(F.row_number().over(same) > 1, "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    return placed.select("conv_id", "turn", "role", "text", fault.alias("fault"), (F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au")).alias("clash"), "place")


def _path(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _after(path: Column, cost: Column | int, letters: str) -> Column:
    return _path(path["cost"] + (F.lit(cost) if isinstance(cost, int) else cost), F.concat(path["audit"], F.lit(letters)))


def _start(state: Column) -> Column:
    """The four states when a fold starts in number ``state``."""
    return F.struct(*(_path(F.when(state == k, 0).otherwise(_FAR), F.lit("")).alias(name) for k, name in enumerate(_STATES)))


def inserted(x: Column) -> Column:
    """The four states after the insertions that pay."""
    e, s, u, a = (x[name] for name in _STATES)
    user = F.least(u, *(_after(p, INSERT, "I") for p in (e, s, a)))
    assistant = F.least(a, _after(u, INSERT, "J"), *(_after(p, 2 * INSERT, "IJ") for p in (e, s)))
    return F.struct(e.alias("e"), s.alias("s"), user.alias("u"), assistant.alias("a"))


def edited(x: Column, row: Column) -> Column:
    """The four states after insertions and an edit of ``row`` (initial, fault)."""

    def of(q: Column) -> Column:
        more = F.when(row["fault"] == "t", TRUNCATED).otherwise(0)
        must_go = row["fault"].isin("b", "d")
        keep = lambda initial: F.when(must_go | (row["initial"] != initial), _FAR).otherwise(KEEP + more)
        rerole = F.when(must_go, _FAR).otherwise(REROLE + more)
        gone = {name: _after(q[name], DELETE, "D") for name in _STATES}
        user = F.least(gone["u"], *(_after(q[p], keep("u"), "K") for p in "esa"), *(_after(q[p], rerole, "R") for p in "esa"))
        assistant = F.least(gone["a"], _after(q["u"], keep("a"), "K"), _after(q["u"], rerole, "S"))
        return F.struct(gone["e"].alias("e"), F.least(gone["s"], _after(q["e"], keep("s"), "K")).alias("s"), user.alias("u"), assistant.alias("a"))

    return let(inserted(x), of)


def cheapest_edits(rows: Column, block: int = BLOCK) -> Column:
    """The cheapest (cost, audit) for the sorted array ``rows`` of structs with ``initial`` and ``fault``."""

    def folded(part: Column, first: Column) -> Column:
        """For each state that a block may start in, the four states that it ends in."""
        return F.transform(F.when(first, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(3))), lambda k: F.aggregate(part, _start(k), edited))

    def through(x: Column, ends: Column) -> Column:
        """The states ``x``, then a block: (cost, audit) add up along each way."""
        ways = {to: [_path(x[name]["cost"] + F.get(ends, F.lit(k))[to]["cost"], F.concat(x[name]["audit"], F.get(ends, F.lit(k))[to]["audit"])) for k, name in enumerate(_STATES)] for to in _STATES}
        return F.struct(*(F.least(*ways[to]).alias(to) for to in _STATES))

    starts = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(block))
    tables = F.transform(starts, lambda k: folded(F.slice(rows, k, block), k == 1))
    whole = let(tables, lambda t: F.aggregate(F.slice(t, F.lit(2), F.size(t)), F.get(F.get(t, F.lit(0)), F.lit(0)), through))
    return let(let(whole, inserted), lambda x: F.least(x["e"], x["a"]))


def repaired_text(rows: Column, letters: Column) -> Column:
    """``role:text`` of the repaired rows, joined by line breaks; ``letters`` tell roles as the fold writes them."""
    added = lambda x: F.replace(F.replace(x, F.lit("I"), F.lit("user:\n")), F.lit("J"), F.lit("assistant:\n"))

    def line(row: Column, step: Column) -> Column:
        edit = F.right(step, F.lit(1))
        role = F.when(edit == "R", "user").when(edit == "S", "assistant").otherwise(row["role"])
        own = F.when(edit == "D", "").otherwise(F.concat(role, F.lit(":"), row["text"], F.lit("\n")))
        return F.concat(added(F.regexp_replace(step, "[KRSD]", "")), own)

    lines = F.zip_with(rows, F.regexp_extract_all(letters, F.lit("([IJ]*[KRSD])"), F.lit(1)), line)
    whole = F.concat(F.array_join(lines, ""), added(F.regexp_extract(letters, "([IJ]*)$", 1)))
    return let(whole, lambda x: F.left(x, F.length(x) - 1))  # an empty text stays empty


def repaired_conversations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): faults, the cheapest repair and its text."""
    turns = F.array_sort(F.collect_list(F.struct("place", "role", "text", F.substring("role", 1, 1).alias("initial"), "fault")))
    kinds = [F.count(F.when(F.col("fault") == k, 1)).alias(name) for k, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    grouped = with_faults(rows).groupBy("conv_id").agg(gaps.alias("gaps"), *kinds, F.count(F.when(F.col("clash"), 1)).alias("illegal"), turns.alias("turns"))
    solved = grouped.withColumn("best", cheapest_edits(F.col("turns"), block))
    out = solved.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "turns", F.col("best.cost").alias("cost"), F.col("best.audit").alias("letters"))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.translate("letters", "JS", "IR").alias("audit"), repaired_text(F.col("turns"), F.col("letters")).alias("repaired"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    none = rows.groupBy("conv_id").agg(F.count("copy").alias("left")).filter("left = 0")
    found = repaired_conversations(rows.filter("copy is not null").drop("copy"))
    nothing = none.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.lit("").alias("audit"), F.lit("").alias("repaired"))
    both = found.unionByName(nothing)
    return both.select(*(c for c in both.columns if c != "repaired"), F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))


_CRC = "list_transform(range(256), lambda b: list_reduce([b::BIGINT] || list_transform(range(8), lambda k: 0::BIGINT), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_AFTER = lambda p, cost, letter: f"(lpad((left({p}, 14)::BIGINT + {cost})::VARCHAR, 14, '0') || substr({p}, 15) || '{letter}')"
_NONE = "'09999999999999'"


def _sql_inserted(e: str, s: str, u: str, a: str) -> str:
    add = lambda p, c, x: _AFTER(p, c, x)
    return f"{e} AS e, {s} AS s, least({u}, {add(e, 2, 'I')}, {add(s, 2, 'I')}, {add(a, 2, 'I')}) AS u, least({a}, {add(u, 2, 'J')}, {add(e, 4, 'IJ')}, {add(s, 4, 'IJ')}) AS a"


_TRIMMED = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"
_KEEP = lambda c: f"CASE WHEN fault IN ('b', 'd') OR left(role, 1) <> '{c}' THEN 5000000000000 ELSE (fault = 't')::INT END"
_REROLE = "CASE WHEN fault IN ('b', 'd') THEN 5000000000000 ELSE 2 + (fault = 't')::INT END"

#: A recursive fold over a conversation's rows: a path is its cost in 14 digits and then its letters, so that texts compare like structs.
ORACLE = f"""WITH RECURSIVE t AS (SELECT {_CRC} AS tab),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT), lambda h, b: xor(h >> 8, tab[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, t),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c, range(2) x(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
p AS (SELECT *, row_number() OVER w AS place, lag(left(role, 1)) OVER w || left(role, 1) AS pair FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN {_TRIMMED} = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd' WHEN right({_TRIMMED}, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM p),
d AS (SELECT conv_id, 0::BIGINT AS place, '00000000000000' AS e, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a FROM (SELECT DISTINCT conv_id FROM f)
UNION ALL SELECT conv_id, place, {_AFTER("e", 3, "D")}, least({_AFTER("s", 3, "D")}, {_AFTER("e", _KEEP("s"), "K")}),
least({_AFTER("u", 3, "D")}, {", ".join(_AFTER(p, _KEEP("u"), "K") for p in "esa")}, {", ".join(_AFTER(p, _REROLE, "R") for p in "esa")}), least({_AFTER("a", 3, "D")}, {_AFTER("u", _KEEP("a"), "K")}, {_AFTER("u", _REROLE, "S")})
FROM (SELECT f.conv_id, f.place, f.role, f.fault, {_sql_inserted("d.e", "d.s", "d.u", "d.a")} FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.place = d.place + 1)),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY 1),
b AS (SELECT conv_id, n, least(e, a) AS best FROM (SELECT g.conv_id, g.n, {_sql_inserted("d.e", "d.s", "d.u", "d.a")} FROM g JOIN d ON d.conv_id IS NOT DISTINCT FROM g.conv_id AND d.place = g.n)),
l AS (SELECT conv_id, left(best, 14)::BIGINT AS cost, substr(best, 15) AS letters, unnest(regexp_extract_all(substr(best, 15), '[IJ]*[KRSD]')) AS step, generate_subscripts(regexp_extract_all(substr(best, 15), '[IJ]*[KRSD]'), 1) AS place FROM b),
o AS (SELECT l.conv_id, l.place, l.cost, l.letters, replace(replace(regexp_replace(step, '[KRSD]', ''), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) || CASE right(step, 1) WHEN 'D' THEN '' WHEN 'R' THEN 'user:' || text || chr(10) WHEN 'S' THEN 'assistant:' || text || chr(10) ELSE role || ':' || text || chr(10) END AS line FROM l JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.place = l.place),
q AS (SELECT conv_id, min(cost) AS cost, min(letters) AS letters, string_agg(line, '' ORDER BY place) || replace(replace(regexp_extract(min(letters), '[IJ]*$'), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) AS whole FROM o GROUP BY 1)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(translate(letters, 'JS', 'IR'), '') AS audit, sha256(CASE WHEN coalesce(whole, '') = '' THEN '' ELSE left(whole, length(whole) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM i.conv_id"""

"""Document fingerprints: bottom-k sketches of shingle hashes, in SQL functions only.

A sketch is the sorted array of the ``k`` smallest distinct 48-bit hashes of a text's five-word
shingles. Sketches of parts merge to the sketch of the whole. From two sketches follow estimates
of resemblance and containment, from one an estimate of the number of distinct shingles; all are
exact while a set has at most ``k`` shingles. As text a sketch is the base64 form of its hashes,
8 characters each.

Defined results: null text counts as empty; a text of fewer than five words, but not none, has its
whole word sequence as its only shingle; two empty sketches resemble each other fully, an empty and
another one not at all; repeated rows each get a row; rows without ``doc_id`` come after all others;
rows of one id are ordered by a hash of their text, then by text; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.session import table
from cadenza.llm.spans import let

K = 128
SHINGLE = 5
BITS = 48
ROWS_PER_BUCKET = 512
MAX_BUCKETS = 1 << 16


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words between white space."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """48-bit hashes of each run of ``size`` words (of all of them, if they are fewer)."""

    def of(w: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(w, i + k) for k in range(size))), 64 - BITS))
        short = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(w.cast("array<string>"), " ")), 64 - BITS))
        return F.when(F.size(w) >= size, full).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def bottom(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    """The bottom-k sketch of a text."""
    return bottom(shingle_hashes(word_hashes(text)), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(rows: DataFrame, key: str, sketch_: str, k: int = K) -> DataFrame:
    """(key, sketch): for each ``key`` of ``rows`` the sketch of the union of its sets.

    Each task passes on the ``k`` smallest distinct hashes that it has of a key (a group limit of the
    window), so what meets for one key is bounded by the number of tasks, whatever the group's size.
    """
    hashes = rows.select(F.col(key).alias("_key"), F.explode_outer(sketch_).alias("_hash")).distinct()
    place = F.row_number().over(Window.partitionBy("_key").orderBy(F.asc_nulls_last("_hash")))
    least = hashes.withColumn("_place", place).filter(F.col("_place") <= k)
    return least.groupBy(F.col("_key").alias(key)).agg(F.sort_array(F.collect_list("_hash")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two sketched sets."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(sketch_: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    n = F.size(sketch_)
    return F.when(n < k, n.cast("double")).otherwise((k - 1) * F.lit(float(1 << BITS)) / F.element_at(sketch_, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that lies in the second."""
    size_a = distinct_shingles(a, k)
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / size_a))


def as_text(sketch_: Column) -> Column:
    """A sketch in base64, 8 characters a hash."""
    return F.replace(F.base64(F.unhex(F.array_join(F.transform(sketch_, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), ""))), F.lit("\r\n"), F.lit(""))


def _below(bounds: list[int], x: Column, also_equal: bool) -> Column:
    """How many of the sorted ``bounds`` are smaller than ``x`` (or equal to it), by bisection."""
    if not bounds:
        return F.lit(0)
    held = F.lit(bounds).cast("array<bigint>")

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        at = F.get(held, mid)
        up = (acc["lo"] < acc["hi"]) & ((at <= x) if also_equal else (at < x))
        return F.struct(F.when(up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(up | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, step)["lo"]


def with_next(docs: DataFrame, columns: list[str], rows_per_bucket: int = ROWS_PER_BUCKET, derive=None) -> DataFrame:  # noqa: ANN001
    """``docs`` with ``next_<c>`` for each of ``columns``: the value in the row after it by ``doc_id`` (after the last: the first).

    Rows are dealt into buckets at quantiles of the ids, one key for each, and the first row of each
    bucket is also sent to the bucket before it. An id that many rows bear, or none, takes several
    buckets by a hash of the text. The driver sees one id per bucket, of which there are about
    ``MAX_BUCKETS`` at most. ``derive`` is applied to the rows of a bucket before their neighbours are read.
    """
    facts = docs.agg(F.count("doc_id").alias("n"), F.count("*").alias("rows")).first()
    total = max(1, min(MAX_BUCKETS, facts.rows // rows_per_bucket))
    known = max(1, total * facts.n // max(facts.rows, 1))
    bounds: list[int] = []
    if known > 1:
        bounds = list(docs.agg(F.percentile_approx("doc_id", [k / known for k in range(1, known)], max(10_000, 8 * known)).alias("b")).first().b)
    keyed = docs.withColumn("_spread", F.shiftrightunsigned(F.xxhash64("text"), 33))

    def part(parts: Column) -> Column:
        return F.floor(F.col("_spread") * parts / (1 << 31)).cast("int")

    def among_equal(x: Column) -> Column:
        return let(F.struct(_below(bounds, x, False).alias("lo"), _below(bounds, x, True).alias("hi")), lambda q: q["lo"] + part(F.greatest(q["hi"] - q["lo"], F.lit(1))))

    dealt = keyed.withColumn("_bucket", F.when(F.col("doc_id").isNull(), F.lit(known) + part(F.lit(max(1, total - known)))).otherwise(among_equal(F.col("doc_id"))).cast("int"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_spread"))
    heads = sorted((r["_bucket"], r.head.doc_id, r.head["_spread"]) for r in dealt.groupBy("_bucket").agg(first.alias("head")).collect())
    start = dealt.withColumn("_guest", F.lit(0))
    if heads:
        to = docs.sparkSession.createDataFrame([(heads[k - 1][0], *heads[k][1:]) for k in range(len(heads))], "_to int, _head long, _place long")
        found = keyed.join(F.broadcast(to), keyed.doc_id.eqNullSafe(to["_head"]) & (keyed["_spread"] == to["_place"]))
        others = [c for c in docs.columns if c != "text"]
        guests = found.groupBy(F.col("_to").alias("_bucket")).agg(F.min(F.struct("text", *others, "_spread")).alias("g")).select("_bucket", "g.*").withColumn("_guest", F.lit(1))
        start = start.unionByName(guests)
    rows = start.repartition("_bucket")
    rows = derive(rows) if derive else rows
    order = Window.partitionBy("_bucket").orderBy("_guest", F.asc_nulls_last("doc_id"), "_spread", "text")
    return rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).filter("_guest = 0").drop("_bucket", "_guest", "_spread")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, ["text", "own"], derive=lambda d: d.withColumn("own", sketch(F.col("text"))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next_own", sketch(F.col("edited")).alias("changed"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("changed")).alias("near_edited"), resemblance(F.col("own"), F.col("next_own")).alias("near_next"), distinct_shingles(F.col("own")).alias("n_shingles"), containment(F.col("own"), F.col("changed")).alias("kept"))

"""Aggregates: run-length collapse, words of token runs, errors, ranks, calibration, throughput."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import frame_to_ms, normalize_ctc, piece_text, starts_word

HOT_SHARE = 256  # a group of more values than one in so many is ranked in ranges
RANGES = 64


def collapse(frames: DataFrame, blank: int) -> DataFrame:
    """(stream_id, run, token, first, last): runs of equal tokens; a blank ends a run. frames: stream_id, frame, token."""
    w = Window.partitionBy("stream_id").orderBy("frame")
    before = F.lag("token").over(w)
    opens = F.when(before.isNull() | (before != F.col("token")), 1).otherwise(0)
    rows = frames.withColumn("_o", F.when(F.col("token") != blank, opens).otherwise(0)).withColumn("run", F.sum("_o").over(w))
    return rows.filter(F.col("token") != blank).groupBy("stream_id", "run", "token").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def words_of_runs(runs: DataFrame, pieces: DataFrame, duration_ms: int, hop: int = 160, subsample: int = 8, rate: int = 16_000) -> DataFrame:
    """(stream_id, pos, word, start_ms, end_ms): token runs put together at word-start pieces; words that normalise to nothing go."""
    rows = runs.join(pieces, "token").withColumn("text", piece_text(F.col("piece"))).filter("text is not null")
    w = Window.partitionBy("stream_id").orderBy("run")
    rows = rows.withColumn("pos", F.sum(starts_word(F.col("piece")).cast("long")).over(w))
    grouped = rows.groupBy("stream_id", "pos").agg(F.array_sort(F.collect_list(F.struct("run", "text"))).alias("t"), F.min("first").alias("f"), F.max("last").alias("l"))
    word = normalize_ctc(F.array_join(F.transform("t", lambda x: x["text"]), ""))
    at = lambda f: frame_to_ms(f, hop, subsample, rate, F.lit(0), F.lit(duration_ms).cast("long"))
    return grouped.select("stream_id", "pos", word.alias("word"), at(F.col("f")).alias("start_ms"), at(F.col("l") + 1).alias("end_ms")).filter("word <> ''")


def ranked_by(rows: DataFrame, keys: list[str], column: str, ranks: Callable[[Column], dict[float, Column]], times: str | None = None) -> DataFrame:
    """(keys, p, value): for each group its sorted values at the ``ranks`` for its number of values; nulls do not count.

    Values are counted first, so what is ordered is a group's different values. A group that has more than
    one in ``HOT_SHARE`` of them is cut into ranges at its own approximate quantiles, so no task holds more
    than a range; there are less than ``HOT_SHARE`` such groups, whose bounds are broadcast. ``times`` is a
    column that says how often a row counts.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg((F.sum(times) if times else F.count("*")).alias("_n"))
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("_size"), F.percentile_approx(column, [k / RANGES for k in range(1, RANGES)], 1000).alias("_bounds"))
    total = sizes.agg(F.sum("_size").alias("_total"))  # one row
    bounds = sizes.crossJoin(F.broadcast(total)).filter(F.col("_size") * HOT_SHARE > F.col("_total"))
    bounds = bounds.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_bounds")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    part = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(column))), F.lit(0))
    parts = counts.join(F.broadcast(bounds), same, "left").select(*keys, column, "_n", part.alias("_part"))
    running = Window.partitionBy(*keys, "_part")
    parts = parts.withColumn("_below", F.sum("_n").over(running.orderBy(column)))
    by_key = Window.partitionBy(*keys)
    base = parts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))  # at most RANGES rows of a group
    base = base.withColumn("_base", F.sum("_in").over(by_key.orderBy("_part")) - F.col("_in")).withColumn("_all", F.sum("_in").over(by_key))
    base = base.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), "_base", "_all")
    placed = parts.join(base, [*same, F.col("_part") == F.col("_p")])
    upto = F.col("_base") + F.col("_below")
    wanted = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("p"), rank.cast("long").alias("rank")) for q, rank in ranks(F.col("_all")).items())))
    hit = placed.withColumn("_w", wanted).filter((F.col("_w.rank") < upto) & (F.col("_w.rank") >= upto - F.col("_n")))
    return hit.select(*keys, F.col("_w.p").alias("p"), F.col(column).alias("value"))


def _spread(rows: DataFrame, keys: list[str], found: DataFrame, names: dict[float, str]) -> DataFrame:
    """A row for each group of ``rows`` with the value at each p under its name; 0 for no values."""
    values = found.groupBy(*keys).agg(*(F.max(F.when(F.col("p") == q, F.col("value"))).alias(n) for q, n in names.items()))
    values = values.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *names.values())
    groups = rows.select(*keys).distinct()
    joined = groups.join(values, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    return joined.select(*keys, *(F.coalesce(n, F.lit(0)).alias(n) for n in names.values()))


def _nearest(*ps: float) -> Callable[[Column], dict[float, Column]]:
    return lambda n: {p: F.round(F.lit(p / 100) * (n - 1)) for p in ps}


def percentiles_by(rows: DataFrame, keys: list[str], column: str, names: dict[float, str]) -> DataFrame:
    """(keys, names): by group the nearest rank on n - 1, the sorted value at round(p / 100 * (n - 1)); 0 for no values."""
    return _spread(rows, keys, ranked_by(rows, keys, column, _nearest(*names)), names)


def upper_medians_by(rows: DataFrame, keys: list[str], column: str, name: str = "median") -> DataFrame:
    """(keys, name): by group the sorted value at n div 2; 0 for no values."""
    return _spread(rows, keys, ranked_by(rows, keys, column, lambda n: {50: F.call_function("div", n, F.lit(2))}), {50: name})


def interpolated_by(rows: DataFrame, keys: list[str], column: str, names: dict[float, str]) -> DataFrame:
    """(keys, names): by group the value at p / 100 * (n - 1), interpolated between neighbours; no row for no values."""

    def ranks(n: Column) -> dict[float, Column]:
        at = {p: F.lit(p / 100) * (n - 1) for p in names}
        return {p: F.floor(x) for p, x in at.items()} | {p + 1000: F.ceil(x) for p, x in at.items()}

    found = ranked_by(rows, keys, column, ranks)
    sizes = rows.groupBy(*keys).agg(F.count(column).alias("_n"))
    pairs = found.groupBy(*keys).agg(*(F.max(F.when(F.col("p") == q + up, F.col("value"))).alias(f"_{n}{up}") for q, n in names.items() for up in (0, 1000)))
    pairs = pairs.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in pairs.columns if c not in keys))
    joined = sizes.join(pairs, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])

    def between(q: float, n: str) -> Column:
        at = F.lit(q / 100) * (F.col("_n") - 1)
        return (F.col(f"_{n}0") + (at - F.floor(at)) * (F.col(f"_{n}1000") - F.col(f"_{n}0"))).alias(n)

    return joined.select(*keys, *(between(q, n) for q, n in names.items()))


def _whole(rows: DataFrame, column: str, ranks: Callable[[Column], dict[float, Column]], times: str | None) -> DataFrame:
    rows = rows.select(F.lit(0).alias("_one"), column, *([times] if times else []))
    return ranked_by(rows, ["_one"], column, ranks, times).select("p", "value")


def percentile_of(rows: DataFrame, column: str, *ps: float, times: str | None = None) -> DataFrame:
    """(p, value): the nearest ranks of a whole table."""
    return _whole(rows, column, _nearest(*ps), times)


def upper_median_of(rows: DataFrame, column: str, times: str | None = None) -> DataFrame:
    """(p, value): the upper median of a whole table; no row for no values."""
    return _whole(rows, column, lambda n: {50: F.call_function("div", n, F.lit(2))}, times)


def mean_or_nan(column: Column) -> Column:
    return F.coalesce(F.avg(column), F.lit(float("nan")))


def calibration(pairs: DataFrame) -> DataFrame:
    """Offsets that centre start and end, and the errors left after applying them. pairs: start, end, ref_start, ref_end.

    Equal pairs of differences are counted first, and all that follows reads the counts.
    """
    moved = pairs.select((F.col("start") - F.col("ref_start")).alias("s"), (F.col("end") - F.col("ref_end")).alias("e")).groupBy("s", "e").agg(F.count("*").alias("n"))
    one = lambda found, *out: F.broadcast(found.agg(*(F.coalesce(F.max(F.when(F.col("p") == p, F.col("value"))), F.lit(0)).alias(name) for p, name in out)))  # one row
    medians = one(upper_median_of(moved, "s", "n"), (50, "s0")).crossJoin(one(upper_median_of(moved, "e", "n"), (50, "e0"))).select((-F.col("s0")).alias("start_offset"), (-F.col("e0")).alias("end_offset"))
    rows = moved.crossJoin(F.broadcast(medians))
    s, e = F.col("s") + F.col("start_offset"), F.col("e") + F.col("end_offset")
    rows = rows.select("start_offset", "end_offset", "n", F.abs(s).alias("s"), F.abs(e).alias("e"), F.abs(F.call_function("div", s + e, F.lit(2))).alias("m"))
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))
    means = rows.groupBy("start_offset", "end_offset").agg(mean("s").alias("start_mae"), mean("e").alias("end_mae"), mean("m").alias("mid_mae"))
    return means.crossJoin(one(percentile_of(rows, "m", 50, 95, times="n"), (50, "mid_p50"), (95, "mid_p95")))


def throughput(audio_ms: str, service_ms: str, begin: str, end: str, process_ms: int) -> list[Column]:
    """Real-time factors as ratios of sums: by service time, by elapsed time, by the process's lifetime."""
    total = F.sum(audio_ms)
    return [(total / F.sum(service_ms)).alias("service"), (total / (F.max(end) - F.min(begin))).alias("effective"), (total / F.lit(process_ms)).alias("lifecycle")]


def feature_errors(a: str, b: str) -> list[Column]:
    d = F.col(a) - F.col(b)
    return [F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_abs"), F.corr(a, b).alias("correlation")]


def distribution(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, min, mean, p50, p90, p95, p99, max): a distribution report by group."""
    ends = rows.groupBy(*keys).agg(F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max"))
    ps = interpolated_by(rows, keys, column, {p: f"p{p}" for p in (50, 90, 95, 99)})
    ps = ps.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "p50", "p90", "p95", "p99")
    joined = ends.join(ps, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    return joined.select(*keys, "min", "mean", "p50", "p90", "p95", "p99", "max")

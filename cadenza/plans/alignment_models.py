"""Queries for sessions, inference and the remaining parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import frontend
from cadenza.operators import align, inference, metrics, timing, windows
from cadenza.plans.base import WORDS, query, table, values, words
from cadenza.plans.sources_metrics import _SPANS, _TOKENS, _TURNS, _VITERBI, _normal, _timed, _tokens, _turns
from cadenza.plans.live_requests import windows_only


@query("stm_session")
def stm_session(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents as windows of 10 words every 8, then an end frame, through the session rules."""
    return windows_only(spark, d)


@query("inf_dispatch", "SELECT vec_id, k AS window_seq, CASE WHEN k < 5 THEN 1 ELSE 0 END AS n FROM embeddings, range(6) t(k)")
def inf_dispatch(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.hop_windows(table(spark, d, "embeddings").select("vec_id", "embedding", F.size("embedding").cast("long").alias("n")), "n", 16, 4, 2)
    found = inference.transcribe(windows.window_samples(rows, "embedding").select("vec_id", "window_seq", "window"), inference.LevelStub)
    return found.select("vec_id", "window_seq", F.size("words").alias("n"))


@query("inf_logitaxis", "SELECT vec_id, f AS frame, embedding[f * 8 + 1]::DOUBLE AS first, embedding[f + 1]::DOUBLE AS turned FROM embeddings, range(8) t(f)")
def inf_logitaxis(spark: SparkSession, d: str) -> DataFrame:
    """The same scores laid out by time and by token, with and without an axis for the batch: first token of each frame."""

    def run(row: dict) -> list[tuple]:
        x = np.array(row["embedding"], float).reshape(8, 8)
        wide = np.concatenate([x, np.zeros((8, 1))], axis=1)  # nine tokens, so the axes differ
        layouts = [align.logits_time_major(y, 9) for y in (wide, wide.T, wide[None], wide.T[None])]
        if any(y.shape != (8, 9) or not (y == wide).all() for y in layouts):
            raise ValueError("a layout was not told apart")
        turned = align.logits_time_major(np.ascontiguousarray(wide[:, :8].T)[None], 8)  # square: taken as it is
        return [(row["vec_id"], k, float(layouts[1][k, 0]), float(turned[k, 0])) for k in range(8)]

    return align.by_row(table(spark, d, "embeddings").select("vec_id", "embedding"), run, "vec_id long, frame long, first double, turned double")


@query("prj_modelinfo", "SELECT s_suppkey, 'm-' || s_suppkey AS model, 'seq2seq' AS arch FROM supplier")
def prj_modelinfo(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("m-"), F.col("s_suppkey").cast("string"))
    info = F.create_map(name, F.struct(name.alias("name"), F.lit("seq2seq").alias("arch")))
    return table(spark, d, "supplier").select("s_suppkey", info.alias("info")).select("s_suppkey", F.explode("info").alias("model", "v")).select("s_suppkey", "model", "v.arch")


@query("str_prompt", "SELECT n_nationkey, '<|startofcontext|><|' || lower(substring(n_name, 1, 2)) || '|><|' || CASE WHEN n_nationkey % 2 = 0 THEN 'pnc' ELSE 'nopnc' END || '|>' AS prompt FROM nation")
def str_prompt(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array(F.lit("startofcontext"), F.lower(F.substring("n_name", 1, 2)), F.when(F.col("n_nationkey") % 2 == 0, "pnc").otherwise("nopnc"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<|"), p, F.lit("|>"))), "").alias("prompt"))


@query("str_detok", "SELECT n_regionkey, trim(string_agg(CASE WHEN n_nationkey % 7 = 0 THEN 'é' ELSE ' ' || n_name END, '' ORDER BY n_nationkey)) AS text FROM nation WHERE n_nationkey % 5 <> 3 GROUP BY 1")
def str_detok(spark: SparkSession, d: str) -> DataFrame:
    """Pieces to text: word marks become spaces, byte pieces their character, special pieces go."""
    piece = F.expr("CASE WHEN n_nationkey % 5 = 3 THEN '<|eos|>' WHEN n_nationkey % 7 = 0 THEN '<0xE9>' ELSE concat('▁', n_name) END")
    rows = table(spark, d, "nation").withColumn("piece", piece).filter(~F.col("piece").rlike(r"^<\|.*\|>$"))
    one = F.when(F.col("piece").rlike("^<0x[0-9A-F]{2}>$"), F.char(F.conv(F.substring("piece", 4, 2), 16, 10).cast("int"))).otherwise(F.replace("piece", F.lit("▁"), F.lit(" ")))
    ordered = F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("t"))))
    return rows.groupBy("n_regionkey").agg(F.trim(F.array_join(F.transform(ordered, lambda x: x["t"]), "")).alias("text"))


@query("aln_gate", f"""WITH {WORDS}, x AS (SELECT stream_id, pos, pos % 4 <> 3 AS hit FROM w), r AS (SELECT *, pos - sum(CASE WHEN NOT hit THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY pos) AS g FROM x),
l AS (SELECT stream_id, count(*) AS n FROM r WHERE NOT hit GROUP BY stream_id, g), m AS (SELECT stream_id, max(n) AS longest FROM l GROUP BY 1)
SELECT stream_id, count(*) FILTER (hit) >= least(greatest(2, CAST(ceil(count(*) * 0.65::DOUBLE) AS BIGINT)), count(*)) AND coalesce(max(longest), 0) <= 8 AS accepted FROM x LEFT JOIN m USING (stream_id) GROUP BY 1""")
def aln_gate(spark: SparkSession, d: str) -> DataFrame:
    """Enough matched words, and no long run without one."""
    from pyspark.sql import Window

    rows = words(spark, d).withColumn("hit", F.col("pos") % 4 != 3)
    w = Window.partitionBy("stream_id").orderBy("pos")
    runs = rows.withColumn("g", F.sum(F.col("hit").cast("int")).over(w)).groupBy("stream_id", "g").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    sums = runs.groupBy("stream_id").agg(F.sum("hits").alias("matched"), F.sum(F.col("hits") + F.col("misses")).alias("n"), F.max("misses").alias("longest"))
    required = F.least(F.greatest(F.lit(2), F.ceil(F.col("n") * 0.65)), F.col("n"))
    return sums.select("stream_id", ((F.col("matched") >= required) & (F.col("longest") <= 8)).alias("accepted"))


@query("aln_groupdp")
def aln_groupdp(spark: SparkSession, d: str) -> DataFrame:
    def run(row: dict) -> list[tuple]:
        ref, ref_ms = _timed(row["hyp"], 100)
        hyp = [a + b for a, b in zip(ref[::2], [*ref[1::2], ""], strict=False)]
        return [(row["stream_id"], *g) for g in align.match_groups(hyp, [(k * 200, k * 200 + 190) for k in range(len(hyp))], ref, ref_ms)]

    return align.by_row(_turns(spark, d), run, "stream_id long, hyp_from long, hyp_to long, ref_from long, ref_to long")


@query("mth_power", """WITH x AS (SELECT vec_id, f AS frame, k, sum(embedding[f * 8 + t - 7]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * t / 15)) * cos(2 * pi() * k * t / 16)) AS re, sum(embedding[f * 8 + t - 7]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * t / 15)) * sin(2 * pi() * k * t / 16)) AS im
FROM embeddings, range(8) a(f), range(9) b(k), range(16) c(t) WHERE f * 8 + t - 7 BETWEEN 1 AND 64 GROUP BY ALL)
SELECT vec_id, frame, round(sum(re * re + im * im), 5) AS energy FROM x GROUP BY ALL""")
def mth_power(spark: SparkSession, d: str) -> DataFrame:
    def energy(x: np.ndarray) -> list[np.ndarray]:
        return [frontend.power_spectra(x, 16, 8, 16).sum(2)]

    return align.by_batch(table(spark, d, "embeddings").select("vec_id", "embedding"), energy, "vec_id", "embedding", "vec_id long, frame long, energy double").withColumn("energy", F.round("energy", 5))


@query("inf_target", f"""WITH {_TURNS}, u AS (SELECT stream_id, unnest(h) AS word, unnest(range(len(h))) AS k FROM f)
SELECT stream_id, word, (sum(length(word)) OVER w - length(word))::BIGINT AS token_start, (sum(length(word)) OVER w)::BIGINT AS token_end FROM u WINDOW w AS (PARTITION BY stream_id ORDER BY k)""")
def inf_target(spark: SparkSession, d: str) -> DataFrame:
    """Normalised words of a text with the numbers of their first and last token (characters as tokens)."""

    def run(row: dict) -> list[tuple]:
        ws = [w for w in _normal(row["hyp"]) if w]
        ends = np.cumsum([len(w) for w in ws], dtype=np.int64).tolist()
        return [(row["stream_id"], w, e - len(w), e) for w, e in zip(ws, ends, strict=True)]

    return align.by_row(_turns(spark, d), run, "stream_id long, word string, token_start long, token_end long")


def _rows(row: dict, spans: list) -> list[tuple]:
    return [(row["stream_id"], k, *x) for k, x in enumerate(spans) if x is not None]


@query("tim_charbnd", "SELECT n_nationkey, 100 + 600 * 2 // len(n_name) AS inside, 700 AS at_end, 750 AS at_start FROM nation")
def tim_charbnd(spark: SparkSession, d: str) -> DataFrame:
    """Times at a character of a name, and on the boundary to the word after it."""

    def run(row: dict) -> list[tuple]:
        ms, lengths = [(100, 700), (750, 900)], [len(row["n_name"]), 4]
        return [(row["n_nationkey"], align.boundary_time(ms, lengths, 2, True), align.boundary_time(ms, lengths, lengths[0], False), align.boundary_time(ms, lengths, lengths[0], True))]

    return align.by_row(table(spark, d, "nation").select("n_nationkey", "n_name"), run, "n_nationkey int, inside long, at_end long, at_start long")


@query("aln_mapgroup", f"""WITH {_TURNS}, x AS (SELECT stream_id, k, len(h) * 100 AS d, length(h[2 * k + 1]) AS a, length(h[2 * k + 1]) + length(h[2 * k + 2]) AS l FROM (SELECT *, unnest(range(len(h) // 2)) AS k FROM f))
SELECT stream_id, 2 * k AS pos, greatest(200 * k - 20, 0) AS start_ms, least(200 * k + 190 * a // l + 5, d) AS end_ms FROM x UNION ALL SELECT stream_id, 2 * k + 1, greatest(200 * k + 190 * a // l - 20, 0), least(200 * k + 195, d) FROM x""")
def aln_mapgroup(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's words two by two, heard as one."""

    def run(row: dict) -> list[tuple]:
        ws, out = [w for w in _normal(row["hyp"]) if w], []
        for k in range(0, len(ws) - 1, 2):
            out += align.map_group([ws[k] + ws[k + 1]], [(k * 100, k * 100 + 190)], ws[k : k + 2], len(ws) * 100, align.AnchorConfig(start_offset_ms=-20, end_offset_ms=5))
        return _rows(row, out)

    return align.by_row(_turns(spark, d), run, _SPANS)


@query("aln_recon", """WITH w AS (SELECT conv_id * 1000 + turn AS stream_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations)
SELECT stream_id, k AS pos, CASE WHEN k = 0 THEN 0 ELSE k * 100 + 5 END AS start_ms, CASE WHEN k = n - 1 THEN k * 100 + 110 ELSE k * 100 + 105 END AS end_ms FROM w, LATERAL (SELECT unnest(range(n)) AS k)""")
def aln_recon(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours that overlap by 10 ms meet in the middle."""

    def run(row: dict) -> list[tuple]:
        return _rows(row, align.reconcile([(k * 100, k * 100 + 110) for k in range(len(row["hyp"].split()))]))

    return align.by_row(_turns(spark, d), run, _SPANS)


@query("aln_fill", f"""WITH {_TURNS}, x AS (SELECT stream_id, k, len(h) * 100 + 100 AS d, (len(h) - 1) // 3 * 300 AS a FROM (SELECT stream_id, h, unnest(range(len(h))) AS k FROM n))
SELECT stream_id, k AS pos, CASE WHEN k * 100 > a THEN a + 110 + (d - a - 110) * (k * 100 - a - 90) // (d - a - 90) ELSE k * 100 + 20 END AS start_ms,
CASE WHEN k * 100 > a THEN a + 110 + (d - a - 110) * (k * 100 - a) // (d - a - 90) ELSE k * 100 + 110 END AS end_ms FROM x""")
def aln_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every third word anchored 20 ms late, the others filled in."""

    def run(row: dict) -> list[tuple]:
        ref, ms = _timed(row["hyp"], 100)
        anchors = [(s + 20, e + 20) if k % 3 == 0 else None for k, (s, e) in enumerate(ms)]
        return _rows(row, align.fill(anchors, ref, ms, len(ref) * 100 + 100) if ref else [])

    return align.by_row(_turns(spark, d), run, _SPANS)


@query("mth_dither", """WITH RECURSIVE g AS (SELECT -1 AS i, 64::HUGEINT AS x UNION ALL SELECT i + 1, xor(c, (c << 17) & 18446744073709551615) FROM (SELECT i, xor(b, b >> 7) AS c FROM (SELECT i, xor(x, (x << 13) & 18446744073709551615) AS b FROM g WHERE i < 63)))
SELECT vec_id, i::BIGINT AS i, round((x >> 11)::DOUBLE / 9007199254740992::DOUBLE * 2 - 1, 4) + 0.0 AS noise, embedding[i + 1]::DOUBLE AS sample FROM embeddings, g WHERE i >= 0""")
def mth_dither(spark: SparkSession, d: str) -> DataFrame:
    """The noise that each sample gets, in units of its scale, and the sample with the noise taken off again."""

    def noise(x: np.ndarray) -> list[np.ndarray]:
        dithered = frontend.dither(x, 1e-5)
        return [(dithered - x) / 1e-5, dithered - frontend.dither_noise(x.shape[1], 1e-5)]

    found = align.by_batch(table(spark, d, "embeddings").select("vec_id", "embedding"), noise, "vec_id", "embedding", "vec_id long, i long, noise double, sample double")
    return found.withColumn("noise", F.round("noise", 4) + 0.0).withColumn("sample", F.col("sample").cast("float").cast("double"))


@query("inf_ctctrans", f"""WITH {_TOKENS}, p AS (SELECT *, 'P' || token AS text, token % 2 = 0 AS st FROM c), q AS (SELECT *, sum(st::INT) OVER (PARTITION BY stream_id ORDER BY run)::BIGINT AS pos FROM p),
w AS (SELECT stream_id, pos, lower(string_agg(text, '' ORDER BY run)) AS word FROM q GROUP BY 1, 2), t AS (SELECT stream_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n_words FROM w GROUP BY 1)
SELECT vec_id AS stream_id, coalesce(text, '') AS text, coalesce(n_words, 0) AS n_words FROM embeddings LEFT JOIN t ON stream_id = vec_id""")
def inf_ctctrans(spark: SparkSession, d: str) -> DataFrame:
    """Scores to text: the best token of each frame, runs, words, and the words put together; silence gives an empty text."""
    pieces = values(spark, "token long, piece string", *((k, ("▁" if k % 2 == 0 else "") + f"P{k}") for k in range(7)))
    found = metrics.words_of_runs(metrics.collapse(_tokens(spark, d), 7), pieces, 600)
    texts = found.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"), F.count("*").alias("n_words"))
    all_ = table(spark, d, "embeddings").select(F.col("vec_id").alias("stream_id"))
    return all_.join(texts, "stream_id", "left").select("stream_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_words", F.lit(0)).alias("n_words"))


@query("inf_ctcalign", f"""WITH {_VITERBI}, a AS (SELECT vec_id, k // 2 AS pos, min(first) AS f, max(last) AS l FROM y GROUP BY ALL), n AS (SELECT *, lead(f) OVER (PARTITION BY vec_id ORDER BY pos) AS nx FROM a)
SELECT vec_id AS stream_id, pos, f * 80 AS start_ms, least(CASE WHEN nx > f THEN nx ELSE l + 1 END * 80, 600) AS end_ms FROM n""")
def inf_ctcalign(spark: SparkSession, d: str) -> DataFrame:
    """A known text of two words, of two tokens and one, to word times by forced alignment of the scores."""

    def run(row: dict) -> list[tuple]:
        spans = align.forced_align(np.array(row["embedding"], float).reshape(8, 8), [int(row["label"]) % 7, 6, 0], 7)
        return [(row["vec_id"], k, *x) for k, x in enumerate(spans)]

    frames = align.by_row(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), run, "stream_id long, token long, first long, last long")
    c = lambda v: F.lit(v).cast("long")
    word = lambda pos, a, b: F.struct(c(pos).alias("pos"), c(a).alias("token_start"), c(b).alias("token_end"))
    ws = table(spark, d, "embeddings").select(F.col("vec_id").alias("stream_id"), F.inline(F.array(word(0, 0, 2), word(1, 2, 3))), c(3).alias("n_tokens"), c(600).alias("duration"))
    return timing.words_from_frames(ws, frames, 8, "n_tokens", "duration").select("stream_id", "pos", "start_ms", "end_ms")

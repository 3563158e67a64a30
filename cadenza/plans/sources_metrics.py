"""Queries for sources, sinks, scalars, aggregates and alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import frontend
from cadenza.functions import scalars as S
from cadenza.operators import align, metrics, windows
from cadenza.plans.base import WORDS, query, table, values, words
from cadenza.sources import sinks, streams


# --- sources -------------------------------------------------------------------------------
@query("src_valid", "SELECT event_id, event_id % 3 <> 2 AND user_id % 2 = 0 AND event_id % 5 <> 0 AS ok FROM events")
def src_valid(spark: SparkSession, d: str) -> DataFrame:
    """Heads by event: one third of another encoding, odd users at 8 kHz, every fifth in stereo."""
    encoding, rate = F.when(F.col("event_id") % 3 == 2, "s16le").otherwise("f32le"), F.when(F.col("user_id") % 2 == 0, 16_000).otherwise(8000)
    return table(spark, d, "events").select("event_id", streams.valid_head(encoding, rate, F.when(F.col("event_id") % 5 == 0, 2).otherwise(1)).alias("ok"))


@query("src_f32le", "SELECT vec_id, i, embedding[i + 1]::DOUBLE AS sample FROM embeddings, range(64) t(i)")
def src_f32le(spark: SparkSession, d: str) -> DataFrame:
    rows = sinks.encode_samples(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding").drop("embedding")
    return streams.decode_samples(rows, "body").select("vec_id", F.posexplode("samples").alias("i", "sample")).withColumn("sample", F.col("sample").cast("double"))


@query("snk_f32le", "SELECT vec_id, 4 * len(embedding) AS n_bytes FROM embeddings")
def snk_f32le(spark: SparkSession, d: str) -> DataFrame:
    return sinks.encode_samples(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", F.length("body").alias("n_bytes"))


@query("src_codec", "SELECT o_orderkey, list_transform([o_orderkey % 100, o_custkey % 100], lambda x: ((x + 32 * 256)::DOUBLE / 32768)) AS samples FROM orders")
def src_codec(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: F.concat(F.char((F.col(c) % 100).cast("int")), F.lit(" "))
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(two("o_orderkey"), two("o_custkey")).cast("binary").alias("body"))
    return streams.decode_samples(rows, "body", encoding="linear16").select("o_orderkey", F.col("samples").cast("array<double>").alias("samples"))


@query("src_jsonref", "SELECT (conv_id * 1000 + turn)::VARCHAR AS key, 0 AS pos, role AS word, turn::DOUBLE AS start, turn + 0.5::DOUBLE AS \"end\" FROM conversations UNION ALL SELECT (conv_id * 1000 + turn)::VARCHAR, 1, 'x', 1.5::DOUBLE, 2.5::DOUBLE FROM conversations")
def src_jsonref(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string('{"%d":{"word_segments":[{"word":"%s","start":%d.0,"end":%d.5},{"word":"x","start":1.5,"end":2.5}]}}', F.col("conv_id") * 1000 + F.col("turn"), "role", "turn", "turn")
    return streams.alignments(table(spark, d, "conversations").select(text.alias("json")), "json")


@query("src_jsonkey", "SELECT event_id, props->>'k' AS value FROM events")
def src_jsonkey(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", streams.lookup(F.col("props"), "k").alias("value"))


@query("src_opts", """SELECT page_id, page_id % 3 = 0 AS utterances, page_id % 5 = 1 AS paragraphs, page_id % 2 = 0 AS words, page_id % 4 + 1 AS channels, (page_id % 9) / 4::DOUBLE AS utt_split, page_id % 700 AS endpointing,
CASE WHEN page_id % 7 = 0 THEN NULL ELSE 'l' || (page_id % 7) END AS language FROM pages""")
def src_opts(spark: SparkSession, d: str) -> DataFrame:
    """A request for each page; a header gives words where the address does not, and of a repeated option the last counts."""
    i = F.col("page_id").cast("string")
    of = lambda k: (F.col("page_id") % k).cast("string")
    flag = lambda c: F.when(c, "true").otherwise("false")
    uri = F.concat(F.lit("/listen?n="), i, F.lit("&utterances="), flag(F.col("page_id") % 3 == 0), F.lit("&paragraphs="), flag(F.col("page_id") % 5 == 1), F.lit("&channels=9&channels="), (F.col("page_id") % 4 + 1).cast("string"), F.lit("&utt_split="), ((F.col("page_id") % 9) / 4).cast("string"), F.lit("&endpointing="), of(700), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.concat(F.lit("&language=l"), of(7))))
    o = table(spark, d, "pages").select("page_id", streams.listen_options(uri, F.create_map(F.lit("words"), flag(F.col("page_id") % 2 == 0))).alias("o"))
    return o.select("page_id", *(F.col(f"o.{c}").alias(c) for c in ("utterances", "paragraphs", "words", "channels", "utt_split", "endpointing", "language")))


@query("src_query_values", "SELECT page_id, k, regexp_extract(url, '[?&]' || k || '=([^&#]*)', 1) AS v FROM pages, (VALUES ('page'), ('ref')) t(k) WHERE regexp_matches(url, '[?&]' || k || '=')")
def src_query_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.explode(streams.query_values(F.col("url"))).alias("p"))
    return rows.select("page_id", "p.k", "p.v").filter(F.col("k").isin("page", "ref"))


@query("src_reqid", "SELECT event_id, CASE WHEN user_id - 20 > 0 THEN user_id - 20 WHEN event_id > 0 THEN event_id END AS request_id FROM events")
def src_reqid(spark: SparkSession, d: str) -> DataFrame:
    second = F.concat(F.lit(" "), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", streams.request_id((F.col("user_id") - 20).cast("string"), second).alias("request_id"))


@query("src_vocab", "SELECT n_nationkey AS id, '▁' || n_name AS piece FROM nation")
def src_vocab(spark: SparkSession, d: str) -> DataFrame:
    whole = table(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.concat(F.lit("▁"), F.col("n_name"))))) ).alias("json"))
    return streams.vocabulary(whole, "json")


# --- sinks ---------------------------------------------------------------------------------
@query("snk_stage", """SELECT conv_id * 1000 + turn AS stream_id, 0 AS seq, 'head' AS kind, NULL AS part FROM conversations UNION ALL
SELECT conv_id * 1000 + turn, k + 1, 'body', substring(text, k * 100 + 1, 100) FROM (SELECT *, unnest(range((length(text) + 99) // 100)) AS k FROM conversations) UNION ALL
SELECT conv_id * 1000 + turn, (length(text) + 99) // 100 + 1, 'end', NULL FROM conversations""")
def snk_stage(spark: SparkSession, d: str) -> DataFrame:
    return sinks.staged(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), "text"), "text", 100)


@query("snk_ndjson", "SELECT to_json({'conv_id': conv_id, 'turn': turn, 'role': role})::VARCHAR AS value FROM conversations")
def snk_ndjson(spark: SparkSession, d: str) -> DataFrame:
    return sinks.ndjson(table(spark, d, "conversations"), "conv_id", "turn", "role")


@query("snk_ws", r"""WITH a AS (SELECT conv_id, string_agg(text || chr(13) || chr(10) || chr(10), '' ORDER BY turn) AS t FROM conversations GROUP BY 1),
l AS (SELECT conv_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '\r$', '')), lambda x: x <> '') AS ls FROM a) SELECT conv_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM l""")
def snk_ws(spark: SparkSession, d: str) -> DataFrame:
    return sinks.lines(table(spark, d, "conversations").withColumn("text", F.concat("text", F.lit("\r\n\n"))), "conv_id", "turn", "text")


@query("snk_json", "SELECT o_orderkey, to_json({'key': o_orderkey, 'meta': {'status': o_orderstatus}, 'tags': [o_orderpriority]})::VARCHAR AS body FROM orders")
def snk_json(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status")).alias("meta"), F.array("o_orderpriority").alias("tags"))
    return table(spark, d, "orders").select("o_orderkey", F.to_json(body).alias("body"))


@query("snk_err", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 400 WHEN 1 THEN 503 WHEN 2 THEN 500 ELSE 400 END AS front, CASE event_id % 4 WHEN 0 THEN 400 WHEN 1 THEN 500 WHEN 2 THEN 500 ELSE 400 END AS worker FROM events""")
def snk_err(spark: SparkSession, d: str) -> DataFrame:
    """Events as failures: an empty body, no capacity, one of the event's own type, an undecodable body."""
    message = F.expr("CASE event_id % 4 WHEN 0 THEN 'Request body was empty' WHEN 1 THEN 'no live worker capacity' WHEN 2 THEN concat('failed on ', event_type) ELSE 'could not decode it' END")
    return table(spark, d, "events").select("event_id", S.error_status(message).alias("front"), S.error_status(message, False).alias("worker"))


@query("snk_manifest", "SELECT p_partkey AS path, p_size AS size, 'upload' AS change FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_size + 1, 'delete' FROM part WHERE p_partkey % 3 = 0")
def snk_manifest(spark: SparkSession, d: str) -> DataFrame:
    local = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("long").alias("size"))
    return sinks.manifest_changes(local, local.withColumn("size", F.col("size") + (F.col("path") % 3 == 0).cast("long")))


# --- normalisers and strings -----------------------------------------------------------------
_ODD = "SELECT word FROM (VALUES ('Lisbon,'), ('don''t'), ('o’clock'), ('ÉTÉ'), ('--x!?')) t(word)"


def _odd(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).select("word").distinct().unionByName(values(spark, "word string", ("Lisbon,",), ("don't",), ("o’clock",), ("ÉTÉ",), ("--x!?",)))


def _normaliser(name: str, sql: str, f) -> None:  # noqa: ANN001
    @query(name, f"WITH {WORDS}, o AS (SELECT DISTINCT word FROM w UNION ALL {_ODD}) SELECT word, {sql} AS normal FROM o")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _odd(spark, d).withColumn("normal", f(F.col("word")))


_normaliser("n1", r"regexp_replace(translate(lower(word), '‘’', ''''''), '[^\p{L}\p{N}'']', '', 'g')", S.normalize_ctc)
_normaliser("n2", "lower(regexp_replace(word, '[^A-Za-z0-9'']', '', 'g'))", S.normalize_ascii)
_normaliser("n3", r"regexp_replace(lower(word), '[^\p{L}\p{N}]', '', 'g')", S.normalize_alnum)
_normaliser("n4", r"translate(regexp_replace(word, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", S.normalize_edges)


@query("str_piece", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS text, n_nationkey % 2 = 0 AND n_nationkey % 5 <> 0 AS starts FROM nation")
def str_piece(spark: SparkSession, d: str) -> DataFrame:
    piece = F.expr("CASE WHEN n_nationkey % 5 = 0 THEN '<unk>' WHEN n_nationkey % 2 = 0 THEN concat('▁', n_name) ELSE n_name END")
    return table(spark, d, "nation").select("n_nationkey", S.piece_text(piece).alias("text"), S.starts_word(piece).alias("starts"))


@query("str_pad", "SELECT s_suppkey, printf('utt-%04d', s_suppkey) AS id FROM supplier")
def str_pad(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", S.utterance_id(F.col("s_suppkey")).alias("id"))


@query("str_envnorm", "SELECT p_partkey, replace(lower(trim(p_brand)), '-', '_') AS name FROM part")
def str_envnorm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.enum_name(F.concat(F.lit(" "), F.upper("p_brand"))).alias("name"))


@query("hsh_sha", "SELECT doc_id, sha256(text) AS digest FROM documents")
def hsh_sha(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("jsn", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def jsn(spark: SparkSession, d: str) -> DataFrame:
    back = F.from_json(F.to_json(F.from_json("props", "k int")), "k int")
    return table(spark, d, "events").select("event_id", back["k"].alias("k"))


# --- samples and features ----------------------------------------------------------------------
@query("mth_rms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 64), 6) AS rms FROM embeddings")
def mth_rms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(S.rms(F.col("embedding")), 6).alias("rms"))


@query("mth_preemph", "SELECT vec_id, i, round(CASE WHEN i = 0 THEN embedding[1]::DOUBLE ELSE embedding[i + 1]::DOUBLE - 0.97::DOUBLE * embedding[i]::DOUBLE END, 6) AS y FROM embeddings, range(64) t(i)")
def mth_preemph(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(S.preemphasis(F.col("embedding"))).alias("i", "y")).withColumn("y", F.round("y", 6))


@query("mth_hann", "SELECT vec_id, i, round(CASE WHEN i >= 12 AND i < 52 THEN 0.5 - 0.5 * cos(2 * pi() * (i - 12) / 39) ELSE 0 END * embedding[i + 1]::DOUBLE, 6) + 0.0 AS y FROM embeddings, range(64) t(i)")
def mth_hann(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as frames of 64 samples under a window of 40 in their middle."""
    windowed = F.zip_with("embedding", frontend.hann(40, 64), lambda x, w: x.cast("double") * w)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(windowed).alias("i", "y")).withColumn("y", F.round("y", 6) + 0.0)


_MEL = """e AS (SELECT i, CASE WHEN m < 15 THEN m * 200 / 3 ELSE 1000 * exp(ln(6.4::DOUBLE) * (m - 15) / 27) END AS hz FROM (SELECT i, i * (15 + 27 * ln(8::DOUBLE) / ln(6.4::DOUBLE)) / 11 AS m FROM range(12) t(i))),
f AS (SELECT a.i AS band, k AS bin, greatest(0, least((k * 16000 / 126 - a.hz) / (b.hz - a.hz), (c.hz - k * 16000 / 126) / (c.hz - b.hz))) * 2 / (c.hz - a.hz) AS w FROM e a JOIN e b ON b.i = a.i + 1 JOIN e c ON c.i = a.i + 2, range(64) t(k))"""


@query("mth_mel", f"WITH {_MEL} SELECT vec_id, band, round(sum(w * embedding[bin + 1]::DOUBLE * embedding[bin + 1]::DOUBLE), 7) + 0.0 AS energy FROM embeddings, f GROUP BY 1, 2")
def mth_mel(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as amplitudes of 64 frequencies: the energy in each of ten mel bands."""
    filters = frontend.mel_filters(n_fft=126, mels=10)

    def bands(x: np.ndarray) -> list[np.ndarray]:
        return [(x * x) @ filters.T]

    return align.by_batch(table(spark, d, "embeddings").select("vec_id", "embedding"), bands, "vec_id", "embedding", "vec_id long, band long, energy double").withColumn("energy", F.round("energy", 7) + 0.0)


@query("mth_norm", "SELECT label, round(avg(z), 6) + 0.0 AS mean, round(stddev_samp(z), 4) AS deviation FROM (SELECT label, (x - avg(x) OVER p) / (stddev_samp(x) OVER p + 1e-5) AS z FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) WINDOW p AS (PARTITION BY label)) GROUP BY 1")
def mth_norm(spark: SparkSession, d: str) -> DataFrame:
    """Each label's values less their mean over their deviation; the two come from one aggregate, joined back by label."""
    rows = table(spark, d, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    facts = rows.groupBy("label").agg(F.avg("x").alias("m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))
    z = (F.col("x") - F.col("m")) / (F.col("s") + 1e-5)
    return rows.join(facts, "label").withColumn("z", z).groupBy("label").agg((F.round(F.avg("z"), 6) + 0.0).alias("mean"), F.round(F.stddev_samp("z"), 4).alias("deviation"))


#: Log-mel bands in SQL, as arrays of frames: embeddings of 64 samples, ``n`` points of which ``w`` have a window, every ``h``.
_LOG_MEL = """s AS (SELECT vec_id, i, embedding[i]::DOUBLE - CASE WHEN i > 1 THEN {e}::DOUBLE * embedding[i - 1]::DOUBLE ELSE 0 END AS x FROM embeddings, range(1, 65) t(i)),
d AS (SELECT vec_id, f, k, sum(x * wt * cos(2 * pi() * k * t / {n})) AS re, sum(x * wt * sin(2 * pi() * k * t / {n})) AS im FROM (SELECT vec_id, f, i - 1 + {n} // 2 - f * {h} AS t, x, 0.5 - 0.5 * cos(2 * pi() * (i - 1 + {n} // 2 - f * {h} - ({n} - {w}) // 2) / ({w} - 1)) AS wt
FROM s, range(64 // {h}) a(f)), range({n} // 2 + 1) b(k) WHERE t >= ({n} - {w}) // 2 AND t < ({n} - {w}) // 2 + {w} GROUP BY ALL),
g AS (SELECT i, CASE WHEN m < 15 THEN m * 200 / 3 ELSE 1000 * exp(ln(6.4::DOUBLE) * (m - 15) / 27) END AS hz FROM (SELECT i, i * (15 + 27 * ln(8::DOUBLE) / ln(6.4::DOUBLE)) / ({b} + 1) AS m FROM range({b} + 2) t(i))),
c AS (SELECT x.i AS band, k, greatest(0, least((k * 16000 / {n} - x.hz) / (y.hz - x.hz), (z.hz - k * 16000 / {n}) / (z.hz - y.hz))) * 2 / (z.hz - x.hz) AS w FROM g x JOIN g y ON y.i = x.i + 1 JOIN g z ON z.i = x.i + 2, range({n} // 2 + 1) t(k)),
l AS (SELECT vec_id, band, f, ln(sum(w * (re * re + im * im)) + {q}) AS v FROM d JOIN c USING (k) GROUP BY ALL)"""


@query("mth_logmel", f"WITH {_LOG_MEL.format(e=0.97, n=16, h=8, w=16, b=8, q='pow(2::DOUBLE, -24)')} SELECT vec_id, band, list(round((v - m) / (dev + 1e-5), 4) + 0.0 ORDER BY f) AS values FROM (SELECT *, avg(v) OVER p AS m, stddev_samp(v) OVER p AS dev FROM l WINDOW p AS (PARTITION BY vec_id, band)) GROUP BY ALL")
def mth_logmel(spark: SparkSession, d: str) -> DataFrame:
    rows = frontend.log_mel(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", mels=8, n_fft=16, hop=8, win=16)
    return rows.select("vec_id", F.posexplode("features").alias("band", "values")).withColumn("values", F.transform("values", lambda v: F.round(v, 4) + 0.0))


#: 32 embeddings as the rows of one stream of samples.
_SAMPLE_ROWS = """r AS (SELECT vec_id // 32 AS stream_id, row_number() OVER (PARTITION BY vec_id // 32 ORDER BY vec_id, j) - 1 AS i, v
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS j FROM embeddings)), n AS (SELECT stream_id, count(*) AS n FROM r GROUP BY 1)"""


def _sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.expr("vec_id div 32").alias("stream_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("samples"))


@query("win_hop_rows", f"""WITH {_SAMPLE_ROWS}, w AS (SELECT stream_id, k, n, CASE WHEN n < 100 THEN 0 ELSE (n - 100) // 80 + 1 END AS f, v
FROM (SELECT *, unnest([i // 80, i // 80 - 1]) AS k FROM r) JOIN n USING (stream_id) WHERE k >= 0 AND i < k * 80 + 100)
SELECT stream_id, k AS window_seq, k * 80 AS start_sample, count(*) AS n_samples, k = f AS is_final, sum(CAST(round(v * 1000) AS BIGINT))::BIGINT AS total FROM w WHERE k < f OR (k = f AND n - f * 80 >= 30) GROUP BY ALL""")
def win_hop_rows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of streams whose samples come in many rows."""
    total = F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + F.round(x.cast("double") * 1000).cast("long"))
    return windows.hop_windows_of_rows(_sample_rows(spark, d), 100, 20, 30).withColumn("total", total).drop("window")


@query("mth_logmel_rows", f"""WITH {_SAMPLE_ROWS}, s AS (SELECT stream_id, i, v - 0.97::DOUBLE * coalesce(lag(v) OVER (PARTITION BY stream_id ORDER BY i), 0) AS x FROM r),
d AS (SELECT stream_id, f, k, sum(x * wt * cos(2 * pi() * k * t / 16)) AS re, sum(x * wt * sin(2 * pi() * k * t / 16)) AS im
FROM (SELECT stream_id, f, x, i - f * 8 + 8 AS t, 0.5 - 0.5 * cos(2 * pi() * (i - f * 8 + 8) / 15) AS wt FROM (SELECT *, unnest([i // 8, i // 8 + 1]) AS f FROM s) JOIN n USING (stream_id) WHERE f < n // 8), range(9) b(k) GROUP BY ALL),
g AS (SELECT i, CASE WHEN m < 15 THEN m * 200 / 3 ELSE 1000 * exp(ln(6.4::DOUBLE) * (m - 15) / 27) END AS hz FROM (SELECT i, i * (15 + 27 * ln(8::DOUBLE) / ln(6.4::DOUBLE)) / 9 AS m FROM range(10) t(i))),
c AS (SELECT x.i AS band, k, greatest(0, least((k * 1000 - x.hz) / (y.hz - x.hz), (z.hz - k * 1000) / (z.hz - y.hz))) * 2 / (z.hz - x.hz) AS w FROM g x JOIN g y ON y.i = x.i + 1 JOIN g z ON z.i = x.i + 2, range(9) t(k)),
l AS (SELECT stream_id, band, f, ln(sum(w * (re * re + im * im)) + pow(2::DOUBLE, -24)) AS v FROM d JOIN c USING (k) GROUP BY ALL)
SELECT stream_id, f AS frame, list(round((v - m) / (dev + 1e-5), 4) + 0.0 ORDER BY band) AS bands FROM (SELECT *, avg(v) OVER p AS m, stddev_samp(v) OVER p AS dev FROM l WINDOW p AS (PARTITION BY stream_id, band)) GROUP BY ALL""")
def mth_logmel_rows(spark: SparkSession, d: str) -> DataFrame:
    """Features of streams whose samples come in many rows."""
    frames = frontend.log_mel_frames(_sample_rows(spark, d), mels=8, n_fft=16, hop=8, win=16)
    return frames.withColumn("bands", F.transform("bands", lambda v: F.round(v, 4) + 0.0))


@query("mth_argmax1", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS token FROM embeddings")
def mth_argmax1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", S.argmax_first(F.col("embedding")).alias("token"))


@query("mth_argmax2", "SELECT vec_id, 64 - list_position(list_reverse(list_transform(embedding, lambda x: round(x))), list_max(list_transform(embedding, lambda x: round(x)))) AS token FROM embeddings")
def mth_argmax2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", S.argmax_last(F.transform("embedding", lambda x: F.round(x))).alias("token"))


@query("mth_mid", f"WITH {WORDS} SELECT stream_id, pos, (start_ms + end_ms) // 2 AS mid, abs(start_ms - 1000) AS off, CAST(round(start_ms / 1000::DOUBLE * 1000) AS BIGINT) AS ms FROM w")
def mth_mid(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).select("stream_id", "pos", S.midpoint(F.col("start_ms"), F.col("end_ms")).alias("mid"), F.abs(F.col("start_ms") - 1000).alias("off"), S.seconds_to_ms(F.col("start_ms") / 1000).alias("ms"))


# --- aggregates ----------------------------------------------------------------------------------
def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 frames of 8 logits; the argmax of each frame."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("stream_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("frame"))
    return rows.select("stream_id", "frame", S.argmax_first(F.slice("embedding", F.col("frame") * 8 + 1, F.lit(8))).cast("long").alias("token"))


_TOKENS = """k AS (SELECT vec_id AS stream_id, f AS frame, list_position(embedding[f * 8 + 1 : f * 8 + 8], list_max(embedding[f * 8 + 1 : f * 8 + 8])) - 1 AS token FROM embeddings, range(8) t(f)),
r AS (SELECT *, sum(CASE WHEN token <> 7 AND (b IS NULL OR b <> token) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY frame)::BIGINT AS run FROM (SELECT *, lag(token) OVER (PARTITION BY stream_id ORDER BY frame) AS b FROM k)),
c AS (SELECT stream_id, run, token, min(frame) AS first, max(frame) AS last FROM r WHERE token <> 7 GROUP BY ALL)"""


@query("agg_collapse", f"WITH {_TOKENS} SELECT * FROM c")
def agg_collapse(spark: SparkSession, d: str) -> DataFrame:
    return metrics.collapse(_tokens(spark, d), 7)


@query("agg_words", f"""WITH {_TOKENS}, p AS (SELECT *, 'P' || token AS text, token % 2 = 0 AS st FROM c), q AS (SELECT *, sum(st::INT) OVER (PARTITION BY stream_id ORDER BY run)::BIGINT AS pos FROM p)
SELECT stream_id, pos, lower(string_agg(text, '' ORDER BY run)) AS word, least(CAST(round(min(first) * 80.0) AS BIGINT), 600) AS start_ms, least(CAST(round((max(last) + 1) * 80.0) AS BIGINT), 600) AS end_ms FROM q GROUP BY 1, 2""")
def agg_words(spark: SparkSession, d: str) -> DataFrame:
    pieces = values(spark, "token long, piece string", *((k, ("▁" if k % 2 == 0 else "") + f"P{k}") for k in range(7)))
    return metrics.words_of_runs(metrics.collapse(_tokens(spark, d), 7), pieces, 600)


def _turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring turns of a conversation as hypothesis and reference words."""
    rows = table(spark, d, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("ref", after).filter("ref is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.col("text").alias("hyp"), "ref")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as words of a stream."""
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.col("text").alias("hyp"))


def _normal(text: str) -> list[str]:
    return ["".join(c for c in w.lower() if c.isascii() and (c.isalnum() or c == "'")) for w in text.split()]


#: Neighbouring turns in SQL: normal words of both, and their edit distance, a row of the table at a time.
_PAIRS = r"""t AS (SELECT conv_id * 1000 + turn AS stream_id, text AS hyp, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations),
n AS (SELECT stream_id, list_transform(list_filter(string_split_regex(hyp, '\s+'), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '[^A-Za-z0-9'']', '', 'g'))) AS h,
list_transform(list_filter(string_split_regex(ref, '\s+'), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '[^A-Za-z0-9'']', '', 'g'))) AS r FROM t WHERE ref IS NOT NULL),
f AS (SELECT stream_id, list_filter(h, lambda x: x <> '') AS h, list_filter(r, lambda x: x <> '') AS r, len(r) AS raw FROM n)"""
#: Every turn in SQL: its normal words, with blank ones in ``n`` and without them in ``f``.
_TURNS = r"""n AS (SELECT conv_id * 1000 + turn AS stream_id, list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '[^A-Za-z0-9'']', '', 'g'))) AS h FROM conversations),
f AS (SELECT stream_id, list_filter(h, lambda x: x <> '') AS h FROM n)"""
_EDITS = f"""RECURSIVE {_PAIRS}, k AS MATERIALIZED (SELECT *, len(r) AS words FROM f),
s AS (SELECT stream_id, 0::BIGINT AS i, j, j AS v FROM (SELECT stream_id, unnest(range(words + 1)) AS j FROM k) UNION ALL
SELECT stream_id, i, j, j + min(t - j) OVER (PARTITION BY stream_id ORDER BY j) FROM (SELECT s.stream_id, s.i + 1 AS i, s.j, least(s.v + 1, coalesce(lag(s.v) OVER (PARTITION BY s.stream_id ORDER BY s.j) + (h[s.i + 1] <> r[s.j])::INT, s.v + 1)) AS t FROM s JOIN k USING (stream_id) WHERE s.i < len(h))),
e AS (SELECT k.stream_id, raw, words, v AS edits FROM k JOIN s ON s.stream_id = k.stream_id AND s.i = len(h) AND s.j = words)"""


def _words_of(row: dict) -> tuple[list[str], list[str]]:
    return _normal(row["hyp"]), _normal(row["ref"])


@query("aln_lcs")
def aln_lcs(spark: SparkSession, d: str) -> DataFrame:
    return align.by_row(_turn_pairs(spark, d), lambda r: [(r["stream_id"], len(align.lcs(*_words_of(r))))], "stream_id long, matched long")


def _edits(spark: SparkSession, d: str) -> DataFrame:
    def run(row: dict) -> list[tuple]:
        hyp, ref = _words_of(row)
        said = [w for w in ref if w]
        return [(row["stream_id"], align.edit_distance([w for w in hyp if w], said), len(said), len(ref))]

    return align.by_row(_turn_pairs(spark, d), run, "stream_id long, edits long, ref_words long, raw_words long")


@query("aln_edit", f"WITH {_EDITS} SELECT stream_id, edits FROM e")
def aln_edit(spark: SparkSession, d: str) -> DataFrame:
    return _edits(spark, d).select("stream_id", "edits")


@query("agg_wer", f"WITH {_EDITS} SELECT sum(edits)::BIGINT AS edits, sum(raw)::BIGINT AS words, sum(edits)::DOUBLE / greatest(sum(raw), 1) AS corpus_wer, round(avg(edits::DOUBLE / greatest(words, 1)), 9) AS mean_wer FROM e")
def agg_wer(spark: SparkSession, d: str) -> DataFrame:
    return _edits(spark, d).agg(F.sum("edits").alias("edits"), F.sum("raw_words").alias("words"), (F.sum("edits") / F.greatest(F.sum("raw_words"), F.lit(1))).alias("corpus_wer"), F.round(metrics.mean_or_nan(F.col("edits") / F.greatest("ref_words", F.lit(1))), 9).alias("mean_wer"))


@query("aln_charedit", "SELECT n_regionkey, sum(levenshtein(n_name, r_name))::BIGINT AS edits FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def aln_charedit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_regionkey").agg(F.sum(F.levenshtein("n_name", "r_name")).alias("edits"))


#: Forced alignment over 8 frames and the states blank, token, blank, ... of three tokens, a frame at a time; x, y: the state's path so far.
_VITERBI = """RECURSIVE o AS (SELECT vec_id, embedding AS e, [7, label % 7, 7, 6, 7, 0, 7] AS s FROM embeddings),
p AS (SELECT vec_id, 0 AS t, k, e[s[k] + 1]::DOUBLE AS v, [k] AS path FROM o, (VALUES (1), (2)) x(k) UNION ALL
SELECT vec_id, t, k, v, path FROM (SELECT p.vec_id, p.t + 1 AS t, p.k + m AS k, p.v + e[(p.t + 1) * 8 + s[p.k + m] + 1]::DOUBLE AS v, list_append(p.path, p.k + m) AS path, row_number() OVER (PARTITION BY p.vec_id, p.k + m ORDER BY p.v DESC, m) AS best
FROM p JOIN o USING (vec_id), (VALUES (0), (1), (2)) x(m) WHERE p.t < 7 AND p.k + m <= 7 AND (m < 2 OR ((p.k + m) % 2 = 0 AND s[p.k + m] <> s[p.k]))) WHERE best = 1),
z AS (SELECT vec_id, path FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k DESC) AS best FROM p WHERE t = 7 AND k >= 6) WHERE best = 1),
y AS (SELECT vec_id, k, list_position(path, 2 * k + 2) - 1 AS first, 8 - list_position(list_reverse(path), 2 * k + 2) AS last FROM z, (VALUES (0), (1), (2)) x(k))"""


@query("aln_viterbi", f"WITH {_VITERBI} SELECT vec_id, k, first, last FROM y")
def aln_viterbi(spark: SparkSession, d: str) -> DataFrame:
    def run(row: dict) -> list[tuple]:
        spans = align.forced_align(np.array(row["embedding"], float).reshape(8, 8), [int(row["label"]) % 7, 6, 0], 7)
        return [(row["vec_id"], k, *s) for k, s in enumerate(spans)]

    return align.by_row(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), run, "vec_id long, k long, first long, last long")


def _timed(text: str, step: int) -> tuple[list[str], list[tuple[int, int]]]:
    ws = _normal(text)
    return ws, [(k * step, k * step + step - 10) for k in range(len(ws))]


_SPANS = "stream_id long, pos long, start_ms long, end_ms long"


@query("aln_anchor")
def aln_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Each turn retimed by itself with every seventh word misheard; ``status`` tells why a turn keeps no times, ``got`` and ``needed`` by how much."""

    def run(row: dict) -> list[tuple]:
        ref, ref_ms = _timed(row["hyp"], 100)
        hyp, hyp_ms = ["zz" if k % 7 == 6 else w for k, w in enumerate(ref)], [(s + 15, e + 5) for s, e in ref_ms]
        try:
            got, why = align.anchor(hyp, hyp_ms, ref, ref_ms, len(ref) * 100 + 100), align.Unaligned("ok")
        except align.Unaligned as e:
            got, why = [(-1, -1)] * len(ref), e
        return [(row["stream_id"], k, *x, why.code, why.got, why.needed) for k, x in enumerate(got)]

    return align.by_row(_turns(spark, d), run, f"{_SPANS}, status string, got long, needed long")


@query("aln_filleval")
def aln_filleval(spark: SparkSession, d: str) -> DataFrame:
    def run(row: dict) -> list[tuple]:
        hyp, ms = _timed(row["hyp"], 120)
        ref = _normal(row["ref"])
        times: list = [None] * len(ref)
        for h, r in align.lcs(hyp, ref):
            times[r] = ms[h]
        return [(row["stream_id"], k, *x) for k, x in enumerate(align.fill_by_length(times, list(map(len, ref)), len(hyp) * 120))]

    return align.by_row(_turn_pairs(spark, d), run, _SPANS)


@query("agg_mean", "SELECT event_type, avg(value) AS mean FROM events GROUP BY 1 UNION ALL SELECT 'none', 'NaN'::DOUBLE")
def agg_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    found = rows.groupBy("event_type").agg(metrics.mean_or_nan(F.col("value")).alias("mean"))
    return found.unionByName(rows.filter("false").agg(F.lit("none").alias("event_type"), metrics.mean_or_nan(F.col("value")).alias("mean")))


_RANK = "list_sort(list({c}))[CAST(round({p} * (count(*) - 1)) AS INT) + 1]"


@query("agg_pctl", f"SELECT user_id, {_RANK.format(c='value', p='0.5::DOUBLE')} AS p50, {_RANK.format(c='value', p='0.95::DOUBLE')} AS p95 FROM events GROUP BY 1")
def agg_pctl(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percentiles_by(table(spark, d, "events"), ["user_id"], "value", {50: "p50", 95: "p95"})


@query("agg_pctl_whole", f"SELECT 50::DOUBLE AS p, {_RANK.format(c='l_extendedprice', p='0.5::DOUBLE')} AS value FROM lineitem UNION ALL SELECT 99, {_RANK.format(c='l_extendedprice', p='0.99::DOUBLE')} FROM lineitem")
def agg_pctl_whole(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percentile_of(table(spark, d, "lineitem"), "l_extendedprice", 50, 99)


@query("agg_median", "SELECT l_suppkey, list_sort(list(l_partkey - l_orderkey))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY 1")
def agg_median(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") - F.col("l_orderkey")).alias("x"))
    return metrics.upper_medians_by(rows, ["l_suppkey"], "x")


_CALIB = f"""WITH {WORDS}, x AS (SELECT (pos * 7) % 23 - 5 AS s, (pos * 11) % 31 - 9 AS e FROM w), m AS (SELECT -list_sort(list(s))[count(*) // 2 + 1] AS so, -list_sort(list(e))[count(*) // 2 + 1] AS eo FROM x),
y AS (SELECT so, eo, abs(s + so) AS a, abs(e + eo) AS b, abs(CAST(trunc((s + so + e + eo) / 2) AS BIGINT)) AS c FROM x, m)
SELECT so AS start_offset, eo AS end_offset, avg(a) AS start_mae, avg(b) AS end_mae, avg(c) AS mid_mae, {_RANK.format(c='c', p='0.5::DOUBLE')} AS mid_p50, {_RANK.format(c='c', p='0.95::DOUBLE')} AS mid_p95 FROM y GROUP BY ALL"""


@query("agg_calib", _CALIB)
@query("agg_calib_whole", _CALIB)
def agg_calib(spark: SparkSession, d: str) -> DataFrame:
    rows = words(spark, d).select((F.col("start_ms") + F.expr("(pos * 7) % 23 - 5")).alias("start"), (F.col("end_ms") + F.expr("(pos * 11) % 31 - 9")).alias("end"), F.col("start_ms").alias("ref_start"), F.col("end_ms").alias("ref_end"))
    return metrics.calibration(rows)


@query("agg_rtfx", "SELECT user_id, sum(event_id)::DOUBLE / sum(user_id) AS service, sum(event_id)::DOUBLE / nullif(max(event_id) - min(event_id), 0) AS effective, sum(event_id)::DOUBLE / 5000 AS lifecycle FROM events GROUP BY 1 HAVING count(*) > 1 AND user_id > 0")
def agg_rtfx(spark: SparkSession, d: str) -> DataFrame:
    busy = table(spark, d, "events").filter("user_id > 0").withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).filter("n > 1")
    return busy.groupBy("user_id").agg(*metrics.throughput("event_id", "user_id", "event_id", "event_id", 5000))


@query("agg_capacity", "SELECT s_nationkey, count(*) AS workers, sum(s_suppkey % 7)::BIGINT AS max_inflight, bool_or(s_suppkey % 2 = 0) OR NOT bool_or(s_suppkey % 2 = 1) AS has_processing, bool_or(s_suppkey % 2 = 1) OR NOT bool_or(s_suppkey % 2 = 0) AS has_response FROM supplier GROUP BY 1")
def agg_capacity(spark: SparkSession, d: str) -> DataFrame:
    role = S.worker_role(F.expr("CASE s_suppkey % 2 WHEN 0 THEN 'decode-1' ELSE 'gpu-1' END"))
    p, r = F.bool_or(role == "processing"), F.bool_or(role == "response")
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("workers"), F.sum(F.col("s_suppkey") % 7).alias("max_inflight"), (p | ~r).alias("has_processing"), (r | ~p).alias("has_response"))


@query("agg_logitstat", "SELECT vec_id, count(*) FILTER (x > 0) AS positive, count(*) FILTER (isnan(x)) AS nan, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
def agg_logitstat(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("x"))
    return rows.groupBy("vec_id").agg(F.count_if(F.col("x") > 0).alias("positive"), F.count_if(F.isnan("x")).alias("nan"), F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))


@query("agg_featcmp", "SELECT l_returnflag, round(avg(abs(l_quantity - l_tax)), 6) AS mae, round(sqrt(avg((l_quantity - l_tax) ** 2)), 6) AS rmse, max(abs(l_quantity - l_tax)) AS max_abs, round(corr(l_quantity, l_tax), 6) AS correlation FROM lineitem GROUP BY 1")
def agg_featcmp(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*metrics.feature_errors("l_quantity", "l_tax"))
    return found.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("mae", "rmse")), "max_abs", F.round("correlation", 6).alias("correlation"))


@query("agg_terms", f"WITH {WORDS} SELECT lower(word) AS term, count(*) AS n FROM w GROUP BY 1")
def agg_terms(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).groupBy(F.lower("word").alias("term")).agg(F.count("*").alias("n"))


@query("agg_dist", "SELECT event_type, min(value) AS min, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM events GROUP BY 1")
def agg_dist(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.distribution(table(spark, d, "events"), ["event_type"], "value")
    return found.select("event_type", "min", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p90", "p95", "p99")), "max")

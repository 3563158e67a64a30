"""Each stage of the pipeline against brute force on its own input, written and reread as Parquet in between."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import packing, pieces, quality
from tests.llm.test_operators import ALNUM, LOWER, components, line_classes, words


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root, rnd = tmp_path_factory.mktemp("sf"), random.Random(1)
    passage = " ".join(words(40, 900, 9000))
    shared = " ".join(words(60, 901, 9000))
    rows, labels = [], []
    for i in range(240):
        w = words(60, i, 9000)
        text = "\n".join([" ".join(w[:30]), f"x{i}", " ".join(w[30:])]) + "."
        if i % 6 == 1:
            text = " ".join(x + "***" for x in w[:8] * 4)
        elif i % 12 == 2:
            text = rows[i - 2][1]  # an exact copy
        elif i % 12 == 3:
            text = rows[i - 3][1].replace("\n", "  ").replace("x", "xx", 1)  # a near copy on one line
        elif i % 12 == 4:
            text += "\n" + shared
        elif i % 12 == 5:
            text += " " + passage
        elif i % 24 == 6:
            text = " ".join(words(600, i, 9000)) + " " + " ".join(passage.split()[:14])
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 2:
            labels.append((i, 0 if i % 6 == 1 else 1, 0))
    rows.append((240, None, "en", "s", None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "nothing of this kind")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    docs, columns, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        columns = columns or docs.columns
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == columns
            after = {r.doc_id: r.text for r in out.collect()}
            assert out.count() == len(after)
            assert out.filter("text is not null and n_chars <> length(text)").count() == 0
        if name == "quality_classifier":
            model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            good = {r.doc_id for r in quality.score(docs, model, ["doc_id"]).filter(F.col("quality_score") >= 0.7).collect()}
            assert set(after) == good and sum(i % 6 == 1 for i in after) <= 2 and sum(i % 6 != 1 for i in after) >= 190
        elif name == "line_dedup":
            gone = line_classes(list(before.items()))
            want = {}
            for i, t in before.items():
                lines = (t or "").split("\n")
                left = [x for j, x in enumerate(lines) if (i, j) not in gone]
                if len(left) == len(lines) or "".join(left).strip():
                    want[i] = "\n".join(left) if len(left) < len(lines) else t
            assert after == want and len(want) <= len(before)
        elif name == "ngram_jaccard_join":
            assert set(after) == {i for i, _, c, _ in components(list(before.items())) if i == c}
            assert all(after[i] == before[i] for i in after)
        elif name == "benchmark_decontamination":
            grams = {tuple(w[k : k + 13]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in [ALNUM.findall(r.text)] for k in range(len(w) - 12)}
            for i, t in before.items():
                w = ALNUM.findall((t or "").translate(LOWER))
                hit = {x for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for x in range(k, k + 13)}
                assert (i in after) == (not hit or 20 * len(hit) < len(w))
                if i in after:
                    assert after[i] == t if not hit else ALNUM.findall(after[i].translate(LOWER)) == [x for k, x in enumerate(w) if k not in hit]
                kept[bool(hit), i in after] = kept.get((bool(hit), i in after), 0) + 1
            assert kept[True, False] and kept[True, True] and kept[False, True]
        else:
            tok = pieces.load_tokenizer(packing.TOKENIZER)
            want = collections.Counter((i, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in before.items())
            assert collections.Counter((r.doc_id, r.ids_crc32) for r in out.collect()) == want
        docs = out


def test_run_gives_the_last_stage_s_rows(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(0 <= r.offset and r.offset + r.length <= packing.CAPACITY for r in rows)


def test_stages_pass_other_columns_and_repeated_rows(spark, sf_dir, tmp_path):
    """Columns named like the stages' own, rows given twice, a row without an id, and an empty table."""
    names = ["quality_score", "Score", "gone", "kept", "gone_id", "pos", "line", "n_hit", "contaminated", "contamination", "hit_mark", "node", "component_id", "root", "block"]
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 24 or doc_id = 240")
    wide = whole.unionByName(whole.filter("doc_id in (0, 8)")).unionByName(whole.filter("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(" ".join(words(60, 999, 9000)) + ".")))
    wide = wide.select("*", *(F.lit(f"own {c}").alias(c) for c in names))
    wide.repartition(3).write.parquet(str(tmp_path / "wide"))
    docs = spark.read.parquet(str(tmp_path / "wide"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        times = collections.Counter(r.doc_id for r in rows)
        assert out.columns == docs.columns and all(r[c] == f"own {c}" for r in rows for c in names), name
        assert times[0] == times[8] == (1 if name == "ngram_jaccard_join" else 2) and times[None] == 1, name
        assert len({(r.doc_id, r.text) for r in rows}) == len(times), name
        nothing = stage(spark, docs.limit(0), sf_dir)
        assert nothing.columns == docs.columns and nothing.count() == 0, name
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), sf_dir).count() == 0

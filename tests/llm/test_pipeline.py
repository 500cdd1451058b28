"""The pipeline, stage by stage."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    texts = []
    for i in range(300):
        w = rng.choices(words, k=60)
        if i % 5 == 0:
            w[3] = w[40] = "vilefoo"
        texts.append(" ".join(w))
    clean = [i for i in range(300) if i % 5]
    texts += [texts[clean[0]], texts[clean[0]].replace(" ", "\n"), texts[clean[1]] + " tail", None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copies", F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"out{i}"))
        now = spark.read.parquet(str(tmp_path / f"out{i}"))
        seen[name] = [r.doc_id for r in now.collect()]
    assert set(seen["toxicity"]) == {i for i in range(305) if i >= 300 or i % 5}
    exact = set(seen["exact dedup"])
    assert not {300, 301} <= exact and len(exact & {clean[0], 300, 301}) == 1 and len(exact & {303, 304}) == 1
    assert len(set(seen["near dedup"]) & {clean[1], 302}) == 1
    size = {i: len(re.findall(r"\S+", t or "")) for i, t in enumerate(texts)}
    mixed = sum(size[i] for i in seen["mixing"])
    assert abs(mixed - 1.5 * sum(size[i] for i in seen["near dedup"])) < 500
    assert sorted(set(seen["packing"])) == sorted(set(seen["mixing"]))
    assert len(seen["packing"]) == len(seen["mixing"])


def test_exact_stage_keeps_the_kept_row(spark):
    """Null ids, repeated ids, and another text under the id of a dropped copy."""
    rows = [(None, "a  b c"), (1, "a b c"), (2, "abc"), (2, "another text"), (None, "x y"), (3, "x  y"), (4, "z"), (4, "z"), (5, "p q"), (5, "p\nq")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, "".join(r.text.split()), len(r.text)) for r in out.collect()), key=str)
    assert got == sorted([(None, "abc", 6), (2, "anothertext", 12), (3, "xy", 4), (4, "z", 1), (5, "pq", 3)], key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts_left(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_stages_go_by_row(spark):
    rows = [(1, "x y"), (5, "x y"), (5, "unique text here")]
    want = sorted([(1, "x y"), (5, "unique text here")], key=str)
    assert texts_left(spark, corpus_pipeline.drop_copies, rows) == want
    assert texts_left(spark, corpus_pipeline.drop_near_copies, rows) == want
    rows = [(None, "x y"), (1, "x y"), (5, "x y")]
    assert len(texts_left(spark, corpus_pipeline.drop_copies, rows)) == 1
    assert texts_left(spark, corpus_pipeline.drop_near_copies, rows) == [(1, "x y")]
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, long), (7, long + " more"), (None, long + " again"), (None, None), (None, ""), (3, "other words")]
    assert texts_left(spark, corpus_pipeline.drop_near_copies, rows) == sorted([(7, long), (None, None), (None, ""), (3, "other words")], key=str)


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

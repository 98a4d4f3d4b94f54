"""Stages take effect one after another and agree with plain versions of what they did."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plain import plain_words
from test_neardup import brute as families
from test_substrings import brute as passages
from tiffin.session import Stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    stage = Stage(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF))
        out.append(docs)
    yield out
    stage.close()


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(made):
    assert all(df.columns == made[0].columns for df in made[1:-1])
    assert made[-1].columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_quality_drops_some(made):
    assert 0.7 * made[0].count() < made[1].count() < made[0].count()
    assert not set(texts(made[1])) - set(texts(made[0]))


def test_near_duplicates_keep_the_first(made):
    before = texts(made[1])
    assert sorted(i for i, _ in texts(made[2])) == sorted(i for i, (_, c) in families(before).items() if i == c)


def test_substrings(made):
    before = texts(made[2])
    expected = passages(before, 50)
    after = dict(texts(made[3]))
    assert {i for i, (n, gone, _) in expected.items() if not gone or gone < n} == set(after)
    assert all(len(plain_words(t)) == expected[i][0] - expected[i][1] for i, t in after.items())


def test_mixing_meets_targets(made):
    size, after = {}, {}
    for df, into in ((made[3], size), (made[4], after)):
        for r in df.select("source", "text").collect():
            into[r.source] = into.get(r.source, 0) + len(plain_words(r.text))
    assert abs(sum(after.values()) - 1.5 * sum(size.values())) <= len(size)
    assert all(after.get(s, 0) <= 2 * n for s, n in size.items())


def test_packing_holds_every_document(made):
    out = made[5].collect()
    assert {r.doc_id for r in out} == {i for i, _ in texts(made[4])}
    used = {}
    for r in out:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096


def test_run(spark, made):
    assert corpus_pipeline.run(spark, SF).count() == made[5].count()


def test_rows_that_share_an_id(spark):
    """Another text under the id of a near copy stays; a repeated row stays once; rows without id all stay."""
    words, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(30))
    rows = [(3, words), (7, words), (7, other), (8, other + " more"), (9, "alone"), (9, "alone"), (None, words), (None, words), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, SF)
    assert out.columns == docs.columns
    found = sorted(texts(out), key=str)
    assert found == sorted([(3, words), (7, other), (9, "alone"), (9, None), (None, words), (None, words)], key=str)


def test_clashing_columns_pass_through(spark, made):
    named = ["score", "_quality", "spans", "n_words", "n_removed", "kept_sha256", "taken", "shard"]
    docs = made[0].limit(60)
    for name in named:
        docs = docs.withColumn(name, F.lit(name))
    for title, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns
        if title not in ("quality classifier", "substring dedup"):
            assert out.filter("shard <> 'shard' OR score <> 'score'").count() == 0


def test_what_a_stage_staged_goes_with_it(spark, made, tmp_path):
    root = spark.conf.get("spark.checkpoint.dir") + "/tiffin-stage"
    before = set(os.listdir(root))
    corpus_pipeline.run(spark, SF).count()
    assert len(set(os.listdir(root)) - before) == len(corpus_pipeline.STAGES)


def test_empty_documents(spark, made):
    docs = made[0].limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break

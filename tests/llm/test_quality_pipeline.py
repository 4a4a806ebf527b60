"""Quality classifier on held-out labels, and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from assaykit.llm import quality, stages
from assaykit.llm.quality import N_FEATURES, keep_good, quality_scores, text_features
from assaykit.llm.queries import QUERIES
from assaykit.llm.wordhash import Words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, Text int"


def test_features_of_odd_texts():
    texts = [b"", b"a b\nA b", b" ", "é!!".encode(), b""]
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = text_features(Words(data, np.concatenate(([0], np.cumsum([len(t) for t in texts])))))
    assert out.shape == (5, N_FEATURES) and np.isfinite(out).all()
    assert out[1, 0] == 3 / 7 and out[1, 1] == 1 / 7 and out[1, -3] == 3 / 4 and out[1, -4] == 1
    assert out[3, -4] == 4 and out[0, -1] == out[2, -1] == 1


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    seen, unseen = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    got = {r.doc_id: r.kept for r in quality_scores(docs, seen).collect()}
    assert len(got) == docs.count()
    judged = [(got[r.doc_id], r.quality == 1) for r in unseen.collect()]
    good = [k for k, y in judged if y]
    bad = [k for k, y in judged if not y]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_odd_rows(spark):
    rows = [(i, "clean words here " * 5, "en", "a", 80, 0) for i in range(40)] + [(100 + i, "X!! | %%% " * 5, "de", None, None, 0) for i in range(40)]
    rows += [(None, None, None, None, None, None), (500, None, "en", "a", 0, 0), (501, "", None, "b", -3, 0), (0, rows[0][1], "en", "a", 80, 0), (502, "long " * 100_000, "en", "z", 1, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 100)) for i in [*range(40), *range(100, 140)]] + [(3, 0), (None, 1), (4, None), (9999, 1)], "doc_id bigint, quality int")
    out = quality_scores(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.kept == (r.doc_id < 100) for r in out if r.doc_id is not None and r.doc_id < 140)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {r.doc_id for r in out if r.kept}
    assert keep_good(docs, labels.where("quality = 1")).count() == len(rows)
    assert quality_scores(docs.limit(0), labels).count() == 0
    assert quality_scores(docs.toDF("doc_id", "text", *"abcd").select("doc_id", "text"), labels).count() == len(rows)


def test_class_shares_hold_in_large_tables(spark):
    # nothing tells the classes apart, so a score is the share of the good labels
    docs = spark.range(18_010).selectExpr("id as doc_id", "'some words' as text", "'en' as lang", "'a' as source", "10L as n_chars")
    labels = spark.range(18_000).selectExpr("id as doc_id", "int(id % 3 > 0) as quality")
    out = quality_scores(docs, labels).agg({"score": "min", "kept": "min"}).first()
    assert abs(out["min(score)"] - 2 / 3) < 0.03 and out["min(kept)"]


def test_pseudo_labels_come_from_the_whole_corpus(spark, monkeypatch):
    text = "if(id % 2 = 0, 'clean words here and there', 'X!! | %%% ##') as text"
    docs = spark.range(12_200).selectExpr("id as doc_id", text, "if(id % 2 = 0, 'en', 'de') as lang", "'a' as source", "if(id % 2 = 0, 30L, 9L) as n_chars")
    labels = spark.range(200).selectExpr("id as doc_id", "int(id % 2 = 0) as quality")
    sizes, fit = [], quality._fit
    monkeypatch.setattr(quality, "_fit", lambda rows, view: sizes.append(rows.count()) or fit(rows, view))
    quality.train(docs, labels)
    assert max(sizes) > 12_000


def test_near_stage_keeps_one(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:100] + [rng.choice(base)] + base[101:]), "en", "a", 5, 1) for i in range(5, 25)] + [(1, "other text", "en", "a", 5, 1), (None, "x", "en", "a", 5, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = stages.keep_one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns and sorted([r[0] for r in out.collect()], key=str) == [1, 5, None]


@pytest.fixture(scope="module")
def steps(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).persist()
        out.append((name, docs))
    return out


def test_stages(spark, small, steps):
    names = spark.read.parquet(f"{small}/documents.parquet").columns
    assert [n for n, _ in steps] == [n for n, _ in corpus_pipeline.STAGES]
    assert all(d.columns == names for _, d in steps[:-1])
    kept, lines, near, mixed, encoded = [d for _, d in steps]
    assert 0 < kept.count() < 200 and lines.count() == kept.count()
    assert near.count() <= lines.count()
    ids = {r.doc_id for r in near.select("doc_id").collect()}
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= ids
    assert encoded.count() == mixed.count() and encoded.where("n_tokens != size(ids)").count() == 0


def test_run_repeats(spark, small, steps):
    rows = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.select("doc_id", "n_tokens").collect())
    assert rows(corpus_pipeline.run(spark, small)) == rows(steps[-1][1])


def test_query_covers_all(spark, small):
    assert QUERIES["op2_quality_classifier"](spark, small).count() == 200

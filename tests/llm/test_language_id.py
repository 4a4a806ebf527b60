"""Language mixtures: n-grams and selection against plain versions, shares of planted mixtures, held-out accuracy."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from assaykit.llm import language_id
from assaykit.llm.language_id import CELLS, ORDER, LanguageModel, grams, identify, penalty, predict, train

SCHEMA = "doc_id bigint, text string, lang string, score int, Lang string"


def plain_grams(text):
    raw = b"  " + re.sub(rb"[^a-z\x80-\xff]+", b" ", b"  " + text.encode().lower() + b" ")[1:]
    values = [int.from_bytes(raw[i : i + ORDER], "big") for i in range(len(raw) - ORDER + 1)]
    return Counter(v * 2654435761 % 2**32 >> (32 - language_id.CELL_BITS) for v in values)


def table(texts):
    raws = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])


def test_grams():
    rng = random.Random(1)
    texts = ["", "a", "é", "12 !", "Ab c", "  x", "x  ", "💡 9"] + ["".join(rng.choice("ab Z.é\n9") for _ in range(rng.randrange(40))) for _ in range(200)]
    got = [Counter() for _ in texts]
    for t, c, n in zip(*(x.tolist() for x in grams(*table(texts)))):
        got[t][c] += n
    # bytes lower() leaves A-Z of ASCII only, as wanted
    assert got == [plain_grams(t) for t in texts]


def vocabulary(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiouéü") for _ in range(2)) for _ in range(25)]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(300)]


WORDS = {f"l{i}": vocabulary(i) for i in range(4)}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(9)
    counts = np.zeros((CELLS, 4))
    for j, lang in enumerate(sorted(WORDS)):
        _, cell, n = grams(*table([text(rng, lang, 20_000)]))
        counts[cell, j] = n
    return LanguageModel(sorted(WORDS), counts)


def best_set(model, text_):
    """The best penalised likelihood over all sets of languages, by many steps for each."""
    _, cell, count = grams(*table([text_]))
    p, n = model.p[cell].astype(float), count.sum()
    best = -np.inf
    for k in range(1, 5):
        for chosen in itertools.combinations(range(4), k):
            q, pi = p[:, chosen], np.full(k, 1 / k)
            for _ in range(300):
                pi = pi * ((count / (q @ pi)) @ q) / n
            best = max(best, count @ np.log(q @ pi) - k * penalty(np.array([n]))[0])
    return best


def test_selection_is_near_the_best_of_all_sets(model):
    rng = random.Random(4)
    texts = [" ".join(text(rng, lang, rng.randrange(1, 60)) for lang in rng.sample(sorted(WORDS), rng.randrange(1, 4))) for _ in range(40)]
    shares = model.mixtures(*grams(*table(texts)), len(texts))
    assert np.allclose(shares.sum(axis=1), 1)
    for t, s in zip(texts, shares):
        _, cell, count = grams(*table([t]))
        own = count @ np.log(model.p[cell].astype(float) @ s) - (s > 0).sum() * penalty(np.array([count.sum()]))[0]
        assert own >= best_set(model, t) - 1.0


def test_shares_of_mixtures(model):
    rng = random.Random(8)
    texts = [text(rng, "l1", 300) + " " + text(rng, "l3", 100), text(rng, "l0", 400), " ".join(text(rng, x, 200) for x in ("l0", "l1", "l2"))]
    shares = model.mixtures(*grams(*table(texts)), 3)
    assert np.allclose(shares, [[0, 0.75, 0, 0.25], [1, 0, 0, 0], [1 / 3, 1 / 3, 1 / 3, 0]], atol=0.05)
    alone = np.concatenate([model.mixtures(*grams(*table([t])), 1) for t in texts])
    assert (alone == shares).all()  # a text's result does not depend on its neighbours


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, 40), lang if i % 9 else None) for i, lang in enumerate(list(WORDS) * 30)]
    odd = [(1000, None, "l0"), (1001, "", "l1"), (1002, "12 34 !? 💡", "l2"), (1003, "é", None), (None, text(rng, "l2", 30), "l0"), (None, None, None)]
    odd += [(1004, text(rng, "l3", 30_000), "l3")] + [(1005, text(rng, "l1", 5), "l1")] * 3
    got = identify(spark.createDataFrame([(*r, 1, "x") for r in rows + odd], SCHEMA)).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.score == pytest.approx(r.languages[0].share if r.languages else 0)
        assert r.lang_pred == (r.languages[0].lang if r.languages else "und")
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred in WORDS
    assert by[1004].lang_pred == "l3"
    assert {r.lang_pred for r in got if r.doc_id is None} == {"l2", "und"}
    assert all(r.lang_pred == f"l{r.doc_id % 4}" for r in got if r.doc_id is not None and r.doc_id < 1000)
    # nothing learned, and nothing there
    docs = spark.createDataFrame([(*r[:2], None, 1, "x") for r in rows], SCHEMA)
    assert {(r.lang_pred, r.score) for r in identify(docs).collect()} == {("und", 0.0)}
    assert identify(docs.limit(0)).count() == 0
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        train(docs.select("text", docs.doc_id.cast("string").alias("lang")))


def test_counts_are_those_of_all_rows(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, f"l{i % 3}", i % 7), f"l{i % 3}") for i in range(90)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    want = [sum((plain_grams(t) for _, t, lang in rows if lang == f"l{j}"), Counter()) for j in range(3)]
    full = np.array([[c[i] for c in want] for i in range(CELLS)])
    assert train(docs).languages == ["l0", "l1", "l2"]
    assert (train(docs).p == LanguageModel(["l0", "l1", "l2"], full).p).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)


def test_reads_text_only(spark, model):
    docs = spark.createDataFrame([(1, "x", "lama")], "doc_id bigint, source string, text string")
    assert predict(docs, model).columns == ["doc_id", "source", "lang_pred", "score", "languages"]

"""Exact dedup, mixing and BPE against brute force, SQL and the tokenizer library."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from assaykit.llm.bpe import codec, decode_documents, encode_documents, round_trip_digests
from assaykit.llm.exact_dedup import exact_dedup
from assaykit.llm.mixing import mix_sources, mixed_documents
from assaykit.llm.queries import ORACLES, QUERIES, TOKENIZER
from tools.check_queries import compare, connect

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, source string, SOURCE string, keep_id int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", 1) for d, t, s in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(set(ORACLES) & set(QUERIES)))
def test_matches_sql(spark, small, name):
    status, detail = compare(spark, connect(small), small, name, QUERIES[name], ORACLES[name])
    assert status == "ok", detail


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(1)
    rows = [(i, rng.choice(["Hot TEXT é", "hot text é", "HOT text É"]), rng.choice(["b", "a", None])) for i in range(300)]
    rows += [(i, f"doc {i % 40} " * (i % 7), rng.choice("zyxwé")) for i in range(300, 420)]
    rows += [(None, "hot text É", "b"), (None, None, None), (None, "", "q"), (5, "", "a"), (5, "", "a"), (7, "x" * 50_000, "a")]
    rng.shuffle(rows)
    return rows


def test_exact_dedup(spark, odd_rows):
    groups = defaultdict(list)
    for d, t, _ in odd_rows:
        groups[(t or "").translate(UPPER)].append(d)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            won = first and i == keep
            first = first and not won
            want.append((i, keep, len(ids), won, hashlib.sha256(t.encode()).hexdigest()))
    for parts in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = [tuple(r) for r in exact_dedup(frame(spark, odd_rows)).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert exact_dedup(frame(spark, [])).count() == 0


def fair(sizes, weights, total):
    full = set()
    while True:
        rest, free = total - sum(2 * sizes[s] for s in full), sum(weights[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and rest * weights[s] / free > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: 2 * sizes[s] if s in full else rest * weights[s] / free for s in sizes}
        full |= over


def test_mixing(spark, odd_rows, monkeypatch):
    monkeypatch.setattr("assaykit.llm.mixing.ROWS_PER_RANGE", 50)
    rows = [r for r in odd_rows if r[1] is None or len(r[1]) < 50_000]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    want = fair(sizes, weights, 1.5 * sum(sizes.values()))
    got = mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id) == sorted((d, size(t)) for d, t, _ in rows if d)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    targets = {r.target for r in got}
    assert sorted(targets) == pytest.approx(sorted(set(want.values())))
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    again = mix_sources(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    mixed = mixed_documents(frame(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "SOURCE", "keep_id"]
    words = defaultdict(int)
    for r in mixed.collect():
        words[r[2]] += size(r[1])
    longest = max(size(t) for _, t, _ in rows)
    for s, t in want.items():
        assert int(t) <= words[s] < t + longest
    assert mix_sources(frame(spark, [])).count() == 0 and mixed_documents(frame(spark, [])).count() == 0
    assert [tuple(r) for r in mix_sources(frame(spark, [(1, None, "a")])).collect()] == [(1, 0, 0, 0.0, 0)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def own():
    with open(TOKENIZER, "rb") as f:
        return codec(f.read())


def ids(own, text):
    return [int.from_bytes(x, "little") for x in zip(*[iter(own.encode(text))] * 4)]


def test_every_code_point(own, library):
    points = [chr(c) for c in range(0x32000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}1 " for c in points[i : i + 40]) for i in range(0, len(points), 40)]
    wrong = [hex(ord(t[1])) for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)) if ids(own, t) != e.ids]
    assert not wrong, (len(wrong), wrong[:20])


def test_random_texts(own, library):
    rng = random.Random(3)
    alphabet = list("aaaeeethin  .,'\n\t0123") + ["'s", "'ll", "é", "ß", "日", "本", "🙂", " ", "　", "<|endoftext|>", "Ġ", "\x00", "\x1c"]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        encoded = library.encode(text, add_special_tokens=False).ids
        assert ids(own, text) == encoded, text
        assert own.decode(memoryview_ids(own, text)) == library.decode(encoded, skip_special_tokens=False)
    for text in ("a" * 5000, "ab" * 3000, "the" * 2000, " " * 3000 + "x", "日本" * 1500, "the quick " * 200_000):
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def memoryview_ids(own, text):
    import numpy as np

    return np.frombuffer(own.encode(text), "<u4")


def test_digests_and_round_trip(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for d, t in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(e, skip_special_tokens=False)
        want.append((d, len(e), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in QUERIES["op8_bpe"](spark, small).collect()) == sorted(want)
    encoded = encode_documents(docs, TOKENIZER)
    assert encoded.columns == [*docs.columns, "n_tokens", "ids"]
    assert sorted((r.doc_id, r.text) for r in decode_documents(encoded, TOKENIZER).collect()) == sorted(rows)


def test_odd_documents(spark):
    df = spark.createDataFrame([(1, None, 5, "a"), (1, None, 5, "a"), (None, "", 5, "b")], "doc_id bigint, text string, ids int, TEXT string")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted([tuple(r) for r in round_trip_digests(df, TOKENIZER).collect()], key=repr) == [(1, 0, empty, empty)] * 2 + [(None, 0, empty, empty)]
    assert encode_documents(df, TOKENIZER).columns == ["doc_id", "text", "TEXT", "n_tokens", "ids"]
    assert round_trip_digests(df.limit(0), TOKENIZER).count() == 0

"""Fill-in-the-middle against a plain version, and its round trip."""

import hashlib
import random
import re

import pytest

from assaykit.llm import fill_middle
from assaykit.llm.fill_middle import Choice, fim_digests, fim_documents, fim_pieces, restore_documents

UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s)."}
SCHEMA = "doc_id bigint, text string, form string, Text string, n int"


def plain(doc, text, how=Choice()):
    t = text or ""
    h = hashlib.sha256(f"{how.seed}{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i * 8 : i * 8 + 8], 16) for i in range(4))
    units = re.findall(UNITS[how.unit], t)
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= how.fim_percent:
        return doc, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < how.spm_percent else "psm"
    return doc, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["é\n", "\n", "a b", "<P", "S>", "💡", "\r\n", " \t"]) for _ in range(rng.randrange(9)))) for i in range(200)]
    rows += [(i, f"has {m} inside\n") for i, m in enumerate(("<P>", "<S>", "<M>"), 300)]
    rows += [(None, "x\ny\n"), (None, None), (400, None), (401, ""), (5, "same\nline"), (5, "same\nline"), (5, "other")]
    rows += [(500, "long é💡 line without end " * 9000), (501, "é\n" * 40_000), (-7, "negative\nid")]
    return rows + [(7, "hot\nrow\n")] * 150


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("how", [Choice(), Choice("seed", 60, 20, "char")])
def test_digests_and_texts(spark, odd_rows, how, monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE_BYTES", 1 << 12)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [plain(d, t, how) for d, t in odd_rows]
    full = sorted(((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, odd_rows)), key=repr)
    assert sorted((tuple(r) for r in fim_digests(frame(spark, odd_rows), how).collect()), key=repr) == full
    texts = fim_documents(frame(spark, odd_rows), how)
    assert sorted((tuple(r) for r in texts.collect()), key=repr) == sorted(((w[0], w[1], w[2], w[5]) for w in want), key=repr)
    back = restore_documents(texts)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(((d, t or "") for d, t in odd_rows), key=repr)


def test_pieces_are_small(spark, odd_rows):
    longest = fim_pieces(frame(spark, odd_rows)).selectExpr("max(length(content))").first()[0]
    assert longest <= fill_middle.PIECE_BYTES + 3


def test_empty_and_unknown(spark):
    assert fim_digests(frame(spark, [])).count() == 0
    assert fim_documents(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        fill_middle.unit_ends(fill_middle.np.zeros(1, "u1"), "verse")


def test_one_exchange(spark, small):
    plan = fim_digests(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1

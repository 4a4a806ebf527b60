"""Line dedup against brute force over all pairs of lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from assaykit.llm import line_dedup
from assaykit.llm.line_dedup import dedup_lines, with_lines_removed
from assaykit.llm.queries import QUERIES


def brute(rows):
    """Rows are (doc_id, text) with unique ids, or repeated rows."""
    lines = []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for i, line in enumerate((t.split("\n") if t is not None else [])):
            lines.append((d, t, i, frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))))
    index, gone = {}, set()
    for at, (d, t, i, s) in enumerate(lines):
        seen = {x for w in s for x in index.get(w, ())}
        if any(10 * len(s & lines[x][3]) >= 8 * len(s | lines[x][3]) for x in seen):
            gone.add((d, t, i))
        for w in s:
            index.setdefault(w, []).append(at)
    out = []
    for d, t in rows:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, t, i) not in gone)
        n = 0 if t is None else len(t.split("\n"))
        out.append((d, n, sum((d, t, i) in gone for i in range(n)), kept))
    return sorted(out, key=repr)


def result(spark, rows):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id bigint, text string, LINE_no int")
    return sorted([tuple(r) for r in dedup_lines(df).collect()], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"rare{i}" for i in range(900)]
    bases = [rng.choices(common, k=rng.randrange(1, 9)) + rng.choices(rare, k=rng.choice([0, 2, 5, 20, 70, 300])) for _ in range(25)]
    rows = []
    for d in rng.sample(range(500), 60):
        lines = []
        for _ in range(rng.randrange(0, 12)):
            w = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 2 + len(w) // 6)):
                w[rng.randrange(len(w))] = rng.choice(common + rare)
            rng.shuffle(w)
            lines.append(rng.choice([" ", "  ", "\t", " \r"]).join(w))
        rows.append((d, "\n".join(lines)))
    rows += [rows[3], rows[3], (None, rows[4][1]), (900, None), (901, ""), (902, "\n \n\n"), (903, "long " * 50_000 + "\n" + "long"), (904, "x\nx\nx y")]
    assert result(spark, rows) == brute(rows)


def test_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for d in range(300):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(40)] = f"v{rng.randrange(500)}"
        rows.append((d, " ".join(w) + "\nown line number " + str(d)))
    assert result(spark, rows) == brute(rows)


def test_empty_and_columns(spark):
    assert result(spark, []) == []
    df = spark.createDataFrame([(1, "a b\na b", "x", 7, "y"), (2, None, "x", 8, "y")], "doc_id bigint, text string, lang string, n_chars bigint, Lang string")
    out = with_lines_removed(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a b", "x", 3, "y"), (2, None, "x", 8, "y")]


def test_small_table_and_plan(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op5_line_dedup"](spark, small)
    assert sorted([tuple(r) for r in out.collect()], key=repr) == brute(rows)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def pairs_met(spark, monkeypatch, rows):
    """Pairs of lines that were compared in full."""
    counts, write = [], line_dedup.materialize

    def counted(df, name="table"):
        out = write(df, name)
        if name in ("star", "rest"):
            counts.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    assert result(spark, rows) == brute(rows)
    return sum(counts)


def test_group_met_out_of_document_order(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(base[:57] + [f"own{d}"])) for d in reversed(range(300))]
    assert pairs_met(spark, monkeypatch, rows) < 5 * len(rows)


def test_lines_of_common_words_do_not_meet(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(600)]
    rows = [(d, " ".join(rng.sample(words, 90))) for d in range(600)]
    assert pairs_met(spark, monkeypatch, rows) < 60


def test_similar_lines_share_a_key(spark):
    rng = random.Random(3)
    rows = []
    for n in [*range(4, 60), 71, 95, 127, 128, 143, 255, 300, 301, 330, 512]:
        for _ in range(6):
            m = rng.randint(n, 5 * n // 4)
            common = -(-4 * (n + m) // 9)  # as few as similar lines can share
            if common < n or common < m:
                words = [f"{rng.choice('ab') * rng.randint(1, 9)}{x}" for x in rng.sample(range(10**6), n + m - common)]
                rows.append((" ".join(words[:n]), " ".join(words[n - common :])))

    def keys(at):
        tokens = pairs.select("i", line_dedup._token_set(F.col(at)).alias("tokens"))
        return line_dedup._with_keys(tokens.withColumn("n", F.size("tokens"))).select("i", "n", F.col("keys").alias(at))

    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    found = keys("a").join(keys("b").drop("n"), "i").select("n", F.arrays_overlap("a", "b").alias("met"), F.size("a").alias("k")).collect()
    assert len(found) == len(rows) and all(r.met for r in found)
    assert all(r.k <= 2 * (r.n // 4 + 1) for r in found)

"""MinHash near dedup on fast similarity sketches.

Each set of word shingles is placed into the coordinates of a sketch in rounds: in a round every
shingle falls into one hashed coordinate, and a value of an earlier round wins. Small sets need many
rounds, and rounds of one fixed coordinate each fill what is left, so every coordinate has a value
and the share of equal coordinates stays as concentrated as with independent functions. Bands of
coordinates bring candidates together; every link is confirmed on the full sets.

Equal sets are collapsed first. Then no group is expanded into all pairs: each band is tested
against one of its documents, what is linked becomes one component, and only documents of different
components in a band are tested further.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import pick, tasks_for
from assaykit.llm.wordhash import Words, lists, mix, signed, slices
from assaykit.operators.components import connected_components
from assaykit.session import broadcast_if_small, materialize

BANDS = 40
MISSED = 1e-6  # most that a pair on the threshold may fail to share every band
CELL = 32  # coordinates of which two bits each fit in one number of a signature
MOST_CELLS = 4
PARITY = [f"x{i}" for i in range(8)]  # 64 cells each: whether a cell holds an odd number of a set's shingles
PIVOT_ROUNDS = 3
LABEL_STEPS = 2
MOST_MET = 16  # filter tests a row of a band may take on average before more pivots are worth their jobs
STAR_BLOCK = 128  # documents compared with one copy of a pivot's text
_EMPTY = np.iinfo(np.uint64).max


def rows_per_band(percent: int) -> int:
    """The most coordinates in a band with which a pair on the threshold is missed less than ``MISSED``."""
    return max(r for r in range(1, 33) if r == 1 or (1 - (percent / 100) ** r) ** BANDS <= MISSED)


def signature_names(percent: int) -> list[str]:
    """Columns of a signature: two bits of each coordinate, as far as they fill whole numbers."""
    return [f"s{i}" for i in range(min(MOST_CELLS, BANDS * rows_per_band(percent) // CELL))]


def most_different(percent: int) -> int:
    """Coordinates in which the signatures of a pair on the threshold differ, more only with less than ``MISSED``."""
    n = CELL * len(signature_names(percent))
    p = (1 - percent / 100) * 3 / 4  # two bits of an unequal coordinate are equal a quarter of the time
    tail, different = 1.0, -1
    while tail > MISSED:
        different += 1
        tail -= comb(n, different) * p**different * (1 - p) ** (n - different)
    return different


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence if it is shorter than k."""
    hashes, whole = w.runs(k), w.whole()
    return [
        np.unique(hashes[at : at + n - k + 1]) if n >= k else whole[i : i + min(n, 1)]
        for i, (at, n) in enumerate(zip(w.first.tolist(), w.counts.tolist()))
    ]


def sketch(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates per set; sets without members keep an empty row."""
    n = len(sets)
    out = np.full(n * size, _EMPTY, np.uint64)
    values = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    open_sets = np.array([len(s) > 0 for s in sets], bool)
    for i in range(size):
        if not len(values):
            break
        x = mix(values + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        spot = ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, owner * size + spot, np.uint64(i << 32) | (x & np.uint64(0xFFFFFFFF)))
        open_sets &= (out.reshape(n, size) == _EMPTY).any(axis=1)
        going = open_sets[owner]
        if not going.all():
            values, owner = values[going], owner[going]
    out = out.reshape(n, size)
    for row in np.flatnonzero(open_sets):
        for spot in np.flatnonzero(out[row] == _EMPTY).tolist():
            i = size + spot
            x = mix(sets[row] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            out[row, spot] = np.uint64(i << 32) | (x & np.uint64(0xFFFFFFFF)).min()
    return out


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """One bit for each cell of a set. Two sets differ in at least as many shingles as their bits do."""
    n, cells = len(sets), 64 * len(PARITY)
    values = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    spot = ((mix(values + np.uint64(2)) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    odd = (np.bincount(owner * cells + spot, minlength=n * cells) & 1).astype(np.uint64)
    return (odd.reshape(n, len(PARITY), 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def _profile(k: int, r: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text"), lower=True):
                sets = shingle_sets(w, k)
                flat = sketch(sets, BANDS * r)
                coordinates = flat.reshape(b - a, BANDS, r)
                pairs = mix(flat[:, : CELL * len(names)]) & np.uint64(3)
                signs = (pairs.reshape(b - a, len(names), CELL) << np.arange(0, 2 * CELL, 2, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
                odd = parity(sets)
                bands = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (b - a, 1))
                for i in range(r):
                    bands = mix(bands * np.uint64(0xD6E8FEB86659FD93) + coordinates[:, :, i])
                n = np.array([len(s) for s in sets], np.int64)
                some = n > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(n),
                        pa.array(signed(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64))),
                        pa.array(signed(np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64))),
                        *[pa.array(signed(signs[:, i].copy())) for i in range(len(names))],
                        *[pa.array(signed(odd[:, i].copy())) for i in range(len(PARITY))],
                        lists(signed(bands[some].ravel()), np.where(some, BANDS, 0)),
                    ],
                    ["doc_id", "n", "set1", "set2", *names, *PARITY, "bands"],
                )

    return run


def _confirm(k: int, percent: int):
    """Links of each pivot, whose rows come before those of its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, []
        for batch in batches:
            pivots, ids = batch.column("pivot").to_pylist(), batch.column("id").to_pylist()
            for a, b, w in slices(batch.column("text"), lower=True):
                links = []
                for p, m, s in zip(pivots[a:b], ids[a:b], shingle_sets(w, k)):
                    if p != pivot:
                        pivot, own = p, []
                    if p == m:
                        own.append(s)
                        continue
                    for t in own:
                        common = np.isin(s, t, assume_unique=True, kind="sort").sum()
                        if 100 * common >= percent * (len(s) + len(t) - common) and common:
                            links.append((p, m))
                            break
                if links:
                    yield pa.RecordBatch.from_pydict(
                        {"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())}
                    )

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The (pivot, id) pairs that are links.

    The candidates of a pivot are spread over blocks, and each block gets the pivot's text once.
    """
    n_blocks = F.expr(f"count(*) over (partition by pivot) div {STAR_BLOCK} + 1")
    dealt = pairs.select("pivot", "id", F.pmod(F.xxhash64("id"), n_blocks).alias("block"))
    heads = dealt.select("pivot", "block").distinct().withColumn("id", F.col("pivot"))
    rows = dealt.unionByName(heads).join(texts, "id").withColumn("later", F.col("id") != F.col("pivot"))
    placed = rows.repartition(tasks_for(texts), "pivot", "block").sortWithinPartitions("pivot", "block", "later")
    return placed.select("pivot", "id", "text").mapInArrow(_confirm(k, percent), "u bigint, v bigint")


def _labels(links: DataFrame) -> DataFrame:
    """(node, label): a small document that links lead to from a node, by a few steps of the smallest label.

    Documents of one label are in one component; the reverse need not hold, which only costs tests.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "near")
    for _ in range(LABEL_STEPS):
        around = both.join(near, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("label"))
        around = materialize(around, "near")
        nearer = around.select(F.col("node").alias("label"), F.col("label").alias("next"))
        near = materialize(around.join(nearer, "label").select("node", F.least("label", "next").alias("label")), "near")
    return near


def _different(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the bands that hold more than one label; ``main`` is the label most have."""
    if labels is None:
        current = members.withColumn("comp", F.col("id"))
    else:
        current = members.join(labels, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("label", "id")).drop("node", "label")
    sizes = current.groupBy("band", "comp").agg(F.count("*").alias("n_ids"))
    bands = sizes.groupBy("band").agg(F.count("*").alias("n_comps"), F.sum("n_ids").alias("n_all"), F.max(F.struct("n_ids", "comp")).alias("top"))
    return current.join(bands.where("n_comps > 1").select("band", "n_all", F.col("top.comp").alias("main")), "band")


def _near(percent: int) -> str:
    """Sizes, cells and signatures that a link may have; a link fails the last with less than ``MISSED``."""
    low = int("01" * CELL, 2)  # the lower bit of each coordinate
    unequal = [f"bit_count(((s ^ p_s) | shiftrightunsigned(s ^ p_s, 1)) & {low}L)".replace("s ^ p_s", f"{c} ^ p_{c}") for c in signature_names(percent)]
    odd = " + ".join(f"bit_count({c} ^ p_{c})" for c in PARITY)
    return f"""100 * least(n, p_n) >= {percent} * greatest(n, p_n)
      and {100 + percent} * ({odd}) <= {100 - percent} * (n + p_n)
      and {" + ".join(unequal)} <= {most_different(percent)}"""


def _linked(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Confirmed links among the members of each band that settle their components."""
    links, tested, labels = None, None, None
    fields = ["id", "n", *signature_names(percent), *PARITY, "comp"]
    for turn in range(PIVOT_ROUNDS + 1):
        current = materialize(_different(members, labels), "bands")
        # tests that are left if every document outside a band's main label meets all others
        n, left = current.agg(F.count("*"), F.sum(F.when(F.col("comp") != F.col("main"), F.col("n_all")))).first()
        if not n:
            break
        whole = turn == PIVOT_ROUNDS or left <= MOST_MET * n
        renamed = [F.col(c).alias("pivot" if c == "id" else f"p_{c}") for c in fields]
        if whole:
            outside = current.where("comp != main").select("band", *renamed)
            met = current.join(outside, "band").where(f"comp != p_comp and (comp = main or id < pivot) and {_near(percent)}")
        else:
            chosen = current.groupBy("band").agg(F.min_by(F.struct(*renamed), F.struct(F.xxhash64("id", F.lit(turn)) if turn else F.col("id"), F.col("id").alias("tie"))).alias("c"))
            met = current.join(chosen.select("band", "c.*"), "band").where(f"comp != p_comp and {_near(percent)}")
        pairs = met.select("pivot", "id").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["pivot", "id"], "left_anti")
        pairs = materialize(pairs, "candidates")
        found = materialize(_confirmed(pairs, texts, k, percent), "links")
        links = found if links is None else links.unionByName(found)
        if whole:
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = _labels(links)
    return links


def near_groups(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    Words are lower-cased in A-Z; a set holds the distinct runs of ``k`` words, or the whole sequence
    if there are fewer. Documents are linked if 100 * common >= percent * together; component_id is
    the smallest doc_id that links reach. Texts without words, and null texts, have an empty set and
    are linked with nothing. Rows that share a doc_id are one document, linked by any of its texts.
    A null doc_id is never linked: component_id is null and kept is true. Repeated rows repeat; an
    empty table gives an empty table.
    """
    rows = pick(docs, "doc_id", "text")
    names = signature_names(percent)
    signature = [*names, *PARITY]
    numbers = ", ".join(f"{c} bigint" for c in ["doc_id", "n", "set1", "set2", *signature])
    profile = materialize(rows.mapInArrow(_profile(k, rows_per_band(percent), names), f"{numbers}, bands array<bigint>"), "sketches")
    usable = profile.where("doc_id is not null and n > 0")
    firsts = usable.groupBy("n", "set1", "set2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")).where("n_rows > 1").drop("n_rows")
    slim = materialize(
        profile.drop("bands", *signature).join(firsts, ["n", "set1", "set2"], "left").withColumn("rep", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))).drop("set1", "set2"),
        "rows",
    )
    single = usable.join(firsts, ["n", "set1", "set2"], "left").where("rep is null or rep = doc_id")
    banded = single.select(F.explode("bands").alias("band"), F.col("doc_id").alias("id"))
    shared = banded.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("band")
    together = materialize(banded.join(shared, "band").distinct(), "together")
    ids = broadcast_if_small(together.select("id").distinct(), 1_000_000)
    about = single.select(F.col("doc_id").alias("id"), "n", *signature).distinct()
    members = materialize(together.join(about, "id"), "members")
    texts = materialize(rows.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi"), "texts")
    links = _linked(members, texts, k, percent)
    # a document with several texts joins their groups
    several = slim.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    bridges = slim.where("rep is not null").join(several, "doc_id").select(F.col("rep").alias("u"), F.col("lo").alias("v")).where("u != v")
    edges = bridges if links is None else bridges.unionByName(links)
    found = slim.join(connected_components(edges), F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document stays, with its columns; rows sharing an id stay or go together."""
    gone = near_groups(docs, k, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id = F.col(f"c{docs.columns.index('doc_id')}")
    return plain.join(materialize(gone, "gone"), doc_id == F.col("gone_id"), "left_anti").toDF(*docs.columns)

"""Line dedup by an exact set-similarity join, in column expressions only.

A line is the set of its words. Lines with equal sets are collapsed first. The words of the others fall
into 2^j parts by their hashes. Two lines of similarity 0.8 differ in h words at most, so all parts but
h are equal; the strongest of these, by the letters of its words, is among the h + 1 strongest of either
line. Lines that hold one such part in common meet, by a join on a hash of all its words. Such a key is
several words, so few lines share it by chance where single words are met in ever more lines.

Filters on size and signature are in the join, what passes is verified on the whole sets. A large group
is first tested against one of its lines, so a group of near copies costs its size; lines that this
leaves undecided meet all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import pick
from assaykit.session import broadcast_if_small, discard, materialize

SMALL_GROUP = 64  # lines that may meet all others of their group at once
MOST_SENT = 250_000  # rows of a table that may be broadcast, counted first
LOOKED_UP = 300  # words of a line whose parts are looked up one by one, which is faster but quadratic
_OTHER_SPACE = ("\t", "\x0b", "\f", "\r")


def _words(text: Column) -> Column:
    odd = text.contains(_OTHER_SPACE[0])
    for c in _OTHER_SPACE[1:]:
        odd = odd | text.contains(c)
    return F.split(F.when(odd, F.translate(text, "".join(_OTHER_SPACE), " " * len(_OTHER_SPACE))).otherwise(text), " ")


def _token(word: Column) -> Column:
    """The word's hash, with its length in the last four bits; never null, so that sets are arrays of plain longs."""
    return F.xxhash64(word).bitwiseAND(F.lit(-16)).bitwiseOR(F.least(F.length(word), F.lit(15)).cast("bigint"))


def _token_set(line: Column) -> Column:
    """Distinct words, ordered by hash."""
    every = F.array_distinct(F.transform(_words(line), _token))
    return F.sort_array(F.array_remove(every, _token(F.lit(""))))


def _signed(sets: DataFrame) -> DataFrame:
    """``sets`` with ``sig0`` and ``sig1``, 128 parities of the words: they differ in no more places than the sets do.

    Words below 0 count in the first. The ordered tokens are cut at a number that is no token, as these end in a length.
    """
    sets = sets.withColumn("marked", F.expr("sort_array(concat(tokens, array(0L)))")).withColumn("cut", F.expr("cast(array_position(marked, 0L) as int)"))
    one = "aggregate(slice(marked, {}), 0L, (s, t) -> s ^ shiftleft(1L, cast(shiftright(t, 4) & 63L as int)))"
    return sets.withColumns({"sig0": F.expr(one.format("1, cut - 1")), "sig1": F.expr(one.format("cut + 1, size(marked) - cut"))})


def _with_keys(sets: DataFrame) -> DataFrame:
    """``sets`` with ``keys`` from n and tokens; similar lines that aren't equal have a key in common.

    A line of up to 3 * 2^j - 1 words, or 4 * 2^j - 1 if it is long, has 2^j parts: more than a similar line can
    differ in, so that even of those with words some are equal but for a few lines. The larger line of a pair decides, so a line has keys for the next j as well if a similar line may be
    so large. A part without words is weaker than all others. Where it is among the strongest nevertheless,
    there is one key for all such lines.
    """
    j = "cast(if(n < 48, greatest(2, ceil(log2((n + 0.5D) / 3))), greatest(5, ceil(log2((n + 0.5D) / 4)))) as int)"
    sets = sets.withColumn("j0", F.expr(j)).withColumn("j1", F.expr("j0 + 1"))
    sets = sets.withColumn("most", F.expr("shiftleft(if(j0 < 5, 3L, 4L), j0) - 1")).withColumn("other", F.expr("5 * n div 4"))
    sets = sets.withColumn("h0", F.expr("cast((n + least(other, most)) div 9 as int)"))
    sets = sets.withColumn("h1", F.expr("cast(if(other > most, (n + other) div 9, 0) as int)"))
    for i in (0, 1):
        sets = sets.withColumn(f"parts{i}", F.expr(f"if(h{i} = 0, cast(array() as array<bigint>), transform(tokens, t -> shiftright(t, 64 - j{i})))"))
        looked_up = f"transform(array_distinct(parts{i}), p -> cast(array_position(parts{i}, p) as int))"
        scanned = f"filter(sequence(1, n), k -> k = 1 or get(parts{i}, k - 1) != get(parts{i}, k - 2))"
        sets = sets.withColumn(f"at{i}", F.expr(f"case when h{i} = 0 then cast(array() as array<int>) when n <= {LOOKED_UP} then {looked_up} else {scanned} end"))
        words = f"transform(at{i}, (s, k) -> slice(tokens, s, coalesce(get(at{i}, k + 1), n + 1) - s))"
        letters = "least(aggregate(w, 0L, (s, t) -> s + (t & 15L)), 63L)"
        keys = f"transform({words}, w -> shiftleft({letters}, 57) | shiftrightunsigned(xxhash64(j{i}, w), 7))"
        every = f"concat({keys}, array(shiftrightunsigned(xxhash64(j{i}), 7)))"
        sets = sets.withColumn(f"keys{i}", F.expr(f"slice(sort_array({every}, false), 1, if(h{i} = 0, 0, h{i} + 1))"))
    return sets.withColumn("keys", F.concat("keys0", "keys1"))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, text) of the different rows with text."""
    rows = pick(docs, "doc_id", "text").where("text is not null").withColumn("row_hash", F.xxhash64("text"))
    again = rows.groupBy(F.col("doc_id").alias("a_id"), F.col("row_hash").alias("a_hash")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = broadcast_if_small(materialize(again, "again"), MOST_SENT)
    same = F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("row_hash") == F.col("a_hash"))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "row_hash"]))


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "row_hash", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))


def _order() -> Column:
    """Lines in document order; a null doc_id comes last."""
    return F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row_hash").alias("c"), F.col("line_no").alias("d"))


# Conditions on two lines of a group, a and b.
_SIGNATURE = ["sig0", "sig1"]
_DIFFER = " + ".join(f"bit_count(a.{c} ^ b.{c})" for c in _SIGNATURE)
_MAY_MATCH = f"5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) and 9 * ({_DIFFER}) <= a.n + b.n"
_ONCE = "not (a.done and b.done) and a.lid < b.lid"


def _verified(pairs: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """The later line (lid) of each pair whose whole sets of words are similar."""
    wanted = pairs.select(F.explode(F.array("lid", "o_lid")).alias("lid")).distinct()
    at = F.struct("line_no", "lid", "n")
    spots = reps.join(wanted, "lid").groupBy("doc_id", "row_hash").agg(F.collect_list(at).alias("spots"))
    spots = materialize(spots, "spots").select(F.col("doc_id").alias("s_id"), F.col("row_hash").alias("s_hash"), "spots")
    found = rows.join(broadcast_if_small(spots, MOST_SENT), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("row_hash") == F.col("s_hash")))
    cut = found.select("doc_id", "row_hash", F.split("text", "\n").alias("all"), "spots")
    # a line goes with its own text, which packs better than hashes of its words
    spot = cut.select("doc_id", "row_hash", F.inline(F.transform("spots", lambda s: F.struct(s.lid.alias("lid"), s.n.alias("n"), s.line_no.alias("line_no"), F.get("all", s.line_no).alias("line")))))
    lines = materialize(spot.select("lid", "n", "line", F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "row_hash", "line_no").alias("ord")), "texts")
    other = lines.select(*[F.col(c).alias(f"o_{c}") for c in lines.columns])
    both = pairs.join(lines, "lid").join(other, "o_lid")
    common = F.size(F.array_intersect(F.array_remove(_words(F.col("line")), ""), F.array_remove(_words(F.col("o_line")), "")))
    similar = both.where(9 * common >= 4 * (F.col("n") + F.col("o_n")))
    return similar.select(F.when(F.col("ord") > F.col("o_ord"), F.col("lid")).otherwise(F.col("o_lid")).alias("lid")).distinct()


def _grouped(reps: DataFrame) -> DataFrame:
    """(lid, key, n_lines, n, sig0, sig1): the lines that share a key with another; most keys are those of one line."""
    # both sides read the same exchange, as both need lid, and neither is filtered more than the other
    placed = reps.where("lid is not null").select("lid", F.explode("keys").alias("key")).repartition("key")
    shared = placed.groupBy("key").agg(F.min("lid").alias("first"), F.max("lid").alias("last"), F.count("*").alias("n_lines")).where("first != last")
    found = placed.join(shared.select("key", "n_lines").hint("shuffle_hash"), "key")
    return found.join(reps.select("lid", "n", *_SIGNATURE), "lid")


def _meet(a: DataFrame, b: DataFrame, condition: str) -> DataFrame:
    """(lid, o_lid) of rows of one key that fulfil ``condition`` and may match; a side is not renamed, so equal sides are one exchange."""
    met = a.alias("a").join(b.alias("b"), F.expr(f"a.key = b.key and ({condition}) and {_MAY_MATCH}"))
    return met.select(F.col("a.lid").alias("lid"), F.col("b.lid").alias("o_lid"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, lines): numbers of the lines of each row that match an earlier line."""
    rows = _rows(docs)
    tokens = _lines(rows).select("doc_id", "row_hash", "line_no", _token_set(F.col("line")).alias("tokens"))
    profile = _with_keys(_signed(tokens.withColumn("n", F.size("tokens")))).select(
        "doc_id", "row_hash", "line_no", "n", F.xxhash64("tokens").alias("s1"), F.xxhash64(F.lit(1), "tokens").alias("s2"), *_SIGNATURE, "keys"
    )
    # lines without words are left out on reading: a condition before that would make every set twice
    written = materialize(profile, "lines")
    profile = written.where("n > 0")
    # one hash finds the sets that may come again, so that only their lines are grouped by all of it
    twice = materialize(profile.groupBy("s1").agg(F.count("*").alias("n_lines")).where("n_lines > 1").select("s1"), "twice")
    some = profile.join(broadcast_if_small(twice, MOST_SENT), "s1", "left_semi")
    equal = some.groupBy("n", "s1", "s2").agg(F.min(_order()).alias("first"), F.count("*").alias("n_lines")).where("n_lines > 1").drop("n_lines")
    equal = broadcast_if_small(materialize(equal, "equal"), MOST_SENT)
    marked = profile.join(equal, ["n", "s1", "s2"], "left").withColumn("again", F.coalesce(_order() > F.col("first"), F.lit(False)))
    # lines that come again need no keys, and those that stay no hashes: each is written once
    split = marked.withColumns({"keys": F.when(~F.col("again"), F.col("keys")), "lid": F.monotonically_increasing_id()}).drop("first", "s1", "s2")
    split = materialize(split, "split")
    discard(written)
    copies = split.where("again").select("doc_id", "row_hash", "line_no")
    reps = split.where("not again").drop("again")

    grouped = materialize(_grouped(reps), "grouped")
    in_large = grouped.where(f"n_lines > {SMALL_GROUP}")
    # the earliest line of a group decides all that are similar to it
    heads = in_large.join(reps.select("lid", _order().alias("ord")), "lid").groupBy("key").agg(F.min_by("lid", "ord").alias("lid"))
    star = _meet(in_large, in_large.join(heads, ["key", "lid"], "left_semi"), "a.lid != b.lid").distinct()
    done = materialize(_verified(materialize(star, "star"), reps, rows), "done")

    known = broadcast_if_small(done.withColumn("is_done", F.lit(True)), MOST_SENT)
    grouped = grouped.join(known, "lid", "left").withColumn("done", F.coalesce("is_done", F.lit(False))).drop("is_done")
    # in small groups the conditions name both sides, so both sides of the join are one exchange
    small = grouped.where(f"n_lines <= {SMALL_GROUP}")
    met = _meet(small, small, _ONCE)
    # in large ones those that are done meet only those that aren't
    in_large = grouped.where(f"n_lines > {SMALL_GROUP}")
    met = met.unionByName(_meet(in_large.where("not done"), in_large, "a.lid < b.lid or (b.done and a.lid != b.lid)"))
    met = met.select(F.least("lid", "o_lid").alias("lid"), F.greatest("lid", "o_lid").alias("o_lid")).distinct()
    rest = materialize(met, "rest")
    matched = done.unionByName(_verified(rest, reps, rows)).distinct()
    similar = reps.join(matched, "lid", "left_semi").select("doc_id", "row_hash", "line_no")
    gone = copies.unionByName(similar).groupBy("doc_id", "row_hash").agg(F.collect_set("line_no").alias("lines"))
    return materialize(gone, "gone")


def _kept(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """All rows by position, their kept text, and the numbers of their removed lines."""
    gone = repeated_lines(docs).select(F.col("doc_id").alias("g_id"), F.col("row_hash").alias("g_hash"), F.col("lines").alias("g_lines"))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    joined = plain.join(broadcast_if_small(gone, MOST_SENT), doc_id.eqNullSafe(F.col("g_id")) & (F.xxhash64(text) == F.col("g_hash")), "left")
    removed = F.coalesce("g_lines", F.array().cast("array<int>"))
    kept = F.when(F.col("g_lines").isNull(), text).otherwise(
        F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(removed, i)), "\n")
    )
    return joined, kept, removed


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, and text without the lines that match an earlier one.

    A line matches if 10 * common >= 8 * together for the sets of words. Earlier is by doc_id, then
    by line; every line is judged on the input, also against lines that are removed themselves.
    Lines without words stay. A null text has no lines and stays null; rows with a null doc_id come
    last. Equal rows are one document and get equal results; other rows of one doc_id are ordered by
    a hash of their texts. An empty table gives an empty table.
    """
    joined, kept, removed = _kept(docs)
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    return joined.select(doc_id.alias("doc_id"), n_lines.cast("bigint").alias("n_lines"), F.size(removed).cast("bigint").alias("n_removed"), kept.alias("text"))


def with_lines_removed(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept text; ``n_chars`` follows it where there is such a column."""
    joined, kept, _ = _kept(docs)
    out = [F.col(f"c{i}") for i in range(len(docs.columns))]
    out[docs.columns.index("text")] = kept
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        out[at] = F.when(F.col("g_lines").isNull(), out[at]).otherwise(F.length(kept).cast(docs.schema[at].dataType))
    return joined.select(*[c.alias(f"c{i}") for i, c in enumerate(out)]).toDF(*docs.columns)

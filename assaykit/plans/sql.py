"""SQL of the derived tables, for the side-by-side check."""

# The derived compound table, as common table expressions.
COMPOUNDS = """
b AS (SELECT l_orderkey k, l_partkey % 64 AS p, COUNT(*) v FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_orderkey k, l_suppkey % 32 AS p, COUNT(*) v FROM lineitem GROUP BY 1, 2),
bm AS (SELECT k, map(list(p), list(v)) m FROM b GROUP BY k),
sm AS (SELECT k, map(list(p), list(v)) m FROM s GROUP BY k),
compounds AS (
  SELECT o_orderkey AS compound_id, o_custkey AS group_id, CAST(o_orderpriority = '1-URGENT' AS INT) AS label,
    CASE WHEN bm.k IS NULL THEN NULL ELSE array_to_string(list_transform(range(64), lambda i: coalesce(bm.m[i], 0)), ',') END AS fp_part,
    CASE WHEN sm.k IS NULL THEN NULL ELSE array_to_string(list_transform(range(CASE WHEN o_orderkey % 101 = 0 THEN 31 ELSE 32 END), lambda i: coalesce(sm.m[i], 0)), ',') END AS fp_supp,
    o_totalprice AS mw, CAST(o_orderkey % 1000 AS DOUBLE) / 100 - 5 AS alogp
  FROM orders LEFT JOIN bm ON bm.k = o_orderkey LEFT JOIN sm ON sm.k = o_orderkey)"""

LABELS = """
labels_ AS (
  SELECT o_orderkey AS compound_id, o_custkey AS group_id, CAST(o_orderpriority = '1-URGENT' AS INT) AS label FROM orders)"""

EXPERTS = LABELS + """,
scores AS (
  SELECT compound_id, label,
    CAST(compound_id * 7919 % 700 + 300 * label AS DOUBLE) / 1000 AS a,
    CAST(compound_id * 104729 % 800 + 200 * label AS DOUBLE) / 1000 AS b,
    CAST(compound_id * 1299709 % 900 + 100 * label AS DOUBLE) / 1000 AS c
  FROM labels_)"""

EXPERTS_LONG = EXPERTS + """,
long AS (
  SELECT compound_id, label, 'a' AS model, a AS prob FROM scores
  UNION ALL SELECT compound_id, label, 'b', b FROM scores
  UNION ALL SELECT compound_id, label, 'c', c FROM scores)"""

ADVERSARIAL = LABELS + """,
adv AS (
  SELECT compound_id, group_id, label,
    CAST((group_id * 31 + compound_id * 17) % 10007 AS DOUBLE) / 10007 AS adversarial_score
  FROM labels_)"""

COMPOUND_KEYS = """
keys AS (
  SELECT p_partkey, concat('L', lpad(CAST(p_size AS VARCHAR), 2, '0'), '-', p_partkey % 1000, '-', p_partkey % 77,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('-', p_partkey % 2253) END) AS del_id
  FROM part),
parts AS (
  SELECT p_partkey, del_id,
    nullif(regexp_extract(del_id, '^(L\\d+)-(\\d{1,4})-(\\d{1,4})(?:-(\\d{1,4}))?$', 1), '') AS library,
    CAST(nullif(regexp_extract(del_id, '^(L\\d+)-(\\d{1,4})-(\\d{1,4})(?:-(\\d{1,4}))?$', 2), '') AS INT) AS bb1,
    CAST(nullif(regexp_extract(del_id, '^(L\\d+)-(\\d{1,4})-(\\d{1,4})(?:-(\\d{1,4}))?$', 3), '') AS INT) AS bb2,
    CAST(nullif(regexp_extract(del_id, '^(L\\d+)-(\\d{1,4})-(\\d{1,4})(?:-(\\d{1,4}))?$', 4), '') AS INT) AS bb3
  FROM keys)"""

# Cumulative counts per distinct score of expert a, highest score first.
CURVE = EXPERTS + """,
pts AS (SELECT a AS score, SUM(label) AS pos, SUM(1 - label) AS neg FROM scores GROUP BY a),
curve AS (
  SELECT score, pos, neg,
    CAST(SUM(pos) OVER w AS DOUBLE) AS tp, CAST(SUM(neg) OVER w AS DOUBLE) AS fp,
    CAST(SUM(pos) OVER () AS DOUBLE) AS positives, CAST(SUM(neg) OVER () AS DOUBLE) AS negatives,
    LEAD(pos) OVER (ORDER BY score DESC) AS next_pos, LEAD(neg) OVER (ORDER BY score DESC) AS next_neg
  FROM pts WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pr AS (
  SELECT score AS threshold, tp / (tp + fp) AS "precision", tp / positives AS recall,
    CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / positives) / (tp / (tp + fp) + tp / positives) END AS f1_score
  FROM curve)"""

# Distinct 2048-wide fingerprints (positions whose count is 1) and their similar pairs.
BIT_SETS = """
ones AS (SELECT l_orderkey AS id, l_partkey % 2048 AS bit FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) = 1),
sets AS (SELECT id, list(bit ORDER BY bit) AS bits, COUNT(*) AS n FROM ones GROUP BY id),
uniq AS (SELECT bits, MIN(id) AS rep, MIN(n) AS n, COUNT(*) AS copies FROM sets GROUP BY bits),
idx AS (SELECT rep, unnest(bits) AS bit FROM uniq),
dots AS (SELECT x.rep AS i, y.rep AS j, COUNT(*) AS dot FROM idx x JOIN idx y ON x.bit = y.bit AND x.rep < y.rep GROUP BY 1, 2),
pairs AS (
  SELECT i, j, x.n AS n_i, y.n AS n_j, x.copies AS copies_i, y.copies AS copies_j, dot
  FROM dots JOIN uniq x ON x.rep = i JOIN uniq y ON y.rep = j
  WHERE 25 * dot * dot >= 4 * x.n * y.n)"""


def clusters(table: str, id_col: str) -> str:
    """Cluster numbers per row from ``uniq``, ``pairs`` and ``sets``; to follow WITH RECURSIVE."""
    return f""",
links AS MATERIALIZED (SELECT i, j FROM pairs UNION ALL SELECT j, i FROM pairs),
cc(id, comp) USING KEY (id) AS (
  SELECT rep AS id, rep AS comp FROM uniq
  UNION
  SELECT links.j, MIN(cc.comp) FROM cc JOIN links ON links.i = cc.id
    JOIN recurring.cc r ON r.id = links.j WHERE cc.comp < r.comp GROUP BY links.j),
row_comp AS (
  SELECT t.{id_col} AS id, coalesce(cc.comp, t.{id_col}) AS comp
  FROM {table} t LEFT JOIN sets ON sets.id = t.{id_col}
    LEFT JOIN uniq ON uniq.bits = sets.bits LEFT JOIN cc ON cc.id = uniq.rep),
comps AS (SELECT comp, MIN(id) AS first, COUNT(*) AS n FROM row_comp GROUP BY comp),
numbered AS (SELECT comp, row_number() OVER (ORDER BY n = 1, first) - 1 AS cluster_id FROM comps),
clustered AS (
  SELECT id AS compound_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM row_comp JOIN numbered USING (comp)),
cluster_sizes AS (SELECT cluster_id, COUNT(*) AS n FROM clustered GROUP BY 1)"""


def group_folds(name: str, source: str, group: str, positives: str, k: int, seed: int = 42) -> str:
    """CTEs that end in ``name`` (group, fold): the greedy deal of the groups of ``source``; to follow WITH RECURSIVE.

    ``name`` also prefixes the other CTEs. The recursion takes one left-over group a step.
    """
    zeros = "[" + ", ".join(["CAST(0 AS HUGEINT)"] * k) + "]"
    add = lambda list_, n: f"list_transform({list_}, lambda x, j: CASE WHEN j = s.best THEN x + s.{n} ELSE x END)"
    return f"""
{name}_g AS MATERIALIZED (SELECT {group}, CAST(SUM({positives}) AS BIGINT) AS n1, CAST(COUNT(*) - SUM({positives}) AS BIGINT) AS n0 FROM {source} GROUP BY 1),
{name}_p AS (SELECT n1, n0, COUNT(*) AS c FROM {name}_g GROUP BY 1, 2),
{name}_t AS (SELECT CAST(SUM(n1) AS HUGEINT) AS y1, CAST(SUM(n0) AS HUGEINT) AS y0 FROM {name}_g),
{name}_r AS MATERIALIZED (
  SELECT n1, n0, seat, row_number() OVER (ORDER BY n1 + n0 DESC, n1 DESC, seat) AS i FROM (SELECT n1, n0, unnest(range(c % {k})) AS seat FROM {name}_p)),
{name}_d AS (
  SELECT CAST(0 AS BIGINT) AS i, {zeros} AS a, {zeros} AS b, CAST(0 AS BIGINT) AS f
  UNION ALL
  SELECT s.i, {add("s.a", "n1")}, {add("s.b", "n0")}, s.best
  FROM (
    SELECT r.i, r.n1, r.n0, d.a, d.b, list_sort(list_transform(range(1, {k + 1}), lambda j: {{'c': d.a[j] * r.n1 * t.y0 * t.y0 + d.b[j] * r.n0 * t.y1 * t.y1, 'n': d.a[j] + d.b[j], 'j': j}}))[1].j AS best
    FROM {name}_d d JOIN {name}_r r ON r.i = d.i + 1, {name}_t t) s),
{name}_x AS (
  SELECT g.{group}, g.n1 + g.n0 AS n, c % {k} AS rest,
    row_number() OVER (PARTITION BY g.n1, g.n0 ORDER BY md5(concat('{seed}|', {group})), {group}) - 1 AS j, g.n1, g.n0
  FROM {name}_g g JOIN {name}_p p ON p.n1 = g.n1 AND p.n0 = g.n0),
{name}_y AS (
  SELECT {group}, n, CASE WHEN j < rest THEN d.f - 1 ELSE (j - rest) % {k} END AS f
  FROM {name}_x x LEFT JOIN {name}_r r ON r.n1 = x.n1 AND r.n0 = x.n0 AND r.seat = x.j LEFT JOIN {name}_d d ON d.i = r.i),
{name}_z AS (
  SELECT f, row_number() OVER (ORDER BY abs({k} * COALESCE(m, 0) - (SELECT SUM(n) FROM {name}_y)), md5(concat('{seed}|', f))) - 1 AS fold
  FROM (SELECT unnest(range({k})) AS f) LEFT JOIN (SELECT f, SUM(n) AS m FROM {name}_y GROUP BY 1) USING (f)),
{name} AS (SELECT {group}, CAST(fold AS INT) AS fold FROM {name}_y JOIN {name}_z USING (f))"""

"""Queries over sources, columns, fingerprints and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.functions import fingerprint as fp
from assaykit.functions.scalars import compound_id_parts
from assaykit.operators import adversarial, ordered, profile
from assaykit.plans import fixtures as fx
from assaykit.plans import sql
from assaykit.plans.catalog import query, rounded, text
from assaykit.session import scratch_path
from assaykit.sources import tables as src

PART, SUPP = fx.PART_WIDTH, fx.SUPP_WIDTH


@query("read_projected", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def read_projected(spark, sf):
    return src.read_compounds(
        spark, f"{sf}/orders.parquet", fp_cols=[], num_cols=["o_totalprice"], label="o_orderstatus", keep=["o_orderkey"]
    )


@query("row_cap", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def row_cap(spark, sf):
    return src.read_compounds(
        spark, f"{sf}/orders.parquet", [], ["o_totalprice"], None, ["o_orderkey"], max_rows=1000, order_by="o_orderkey"
    )


@query("row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def row_ids(spark, sf):
    return ordered.global_rank(fx.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "row_id", start=0)


@query("csv_roundtrip", f"WITH {sql.EXPERTS} SELECT compound_id AS RandomID, a AS DELLabel FROM scores")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    out = fx.expert_scores(spark, sf).select(F.col("compound_id").alias("RandomID"), F.col("a").alias("DELLabel"))
    src.write_csv(out, path)
    return src.read_csv(spark, path, out.schema)


@query("tsv_roundtrip", f"WITH {sql.COMPOUNDS} SELECT compound_id, label, fp_part, fp_supp, mw FROM compounds")
def tsv_roundtrip(spark, sf):
    path = scratch_path(spark, "tsv")
    out = fx.compounds(spark, sf).select("compound_id", "label", "fp_part", "fp_supp", "mw")
    src.write_csv(out, path, sep="\t", compression="gzip")
    return src.read_tsv(spark, path, out.schema, partitions=spark.sparkContext.defaultParallelism)


@query(
    "json_roundtrip",
    f"""WITH {sql.EXPERTS_LONG}
    SELECT model, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS positives, ROUND(MAX(prob), 6) AS top FROM long GROUP BY model""",
)
def json_roundtrip(spark, sf):
    path = scratch_path(spark, "json")
    long = fx.expert_scores_long(spark, sf)
    stats = long.groupBy("model").agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"), F.round(F.max("prob"), 6).alias("top")
    )
    src.write_json(stats, path)
    return spark.read.schema(stats.schema).json(path)


@query(
    "parquet_with_column",
    f"WITH {sql.ADVERSARIAL} SELECT compound_id, group_id, label, adversarial_score FROM adv",
)
def parquet_with_column(spark, sf):
    path = scratch_path(spark, "parquet")
    src.write_parquet(fx.adv_scores(spark, sf), path)
    return src.read_table(spark, path)


@query(
    "normalized_sources",
    f"""WITH {sql.COMPOUNDS}
    SELECT compound_id, fp_part, mw AS "MW", alogp AS "ALOGP", CAST(compound_id % 5 = 0 AS INT) AS is_test FROM compounds""",
)
def normalized_sources(spark, sf):
    train, new = fx.sources(spark, sf)
    return adversarial.mark_sources(train, new, ["compound_id", "fp_part", "MW", "ALOGP"])


def _screening_names(spark, sf):
    return fx.compounds(spark, sf).withColumnsRenamed(
        {"fp_part": "ECFP6", "fp_supp": "MACCS", "mw": "MW", "alogp": "AlogP", "label": "DELLabel"}
    )


@query(
    "feature_columns",
    f"""WITH {sql.COMPOUNDS} SELECT compound_id, fp_part AS "ECFP6", fp_supp AS "MACCS", mw AS "MW", alogp AS "ALOGP" FROM compounds""",
)
def feature_columns(spark, sf):
    df = src.normalize_columns(_screening_names(spark, sf))
    found = [c for c in src.known_fingerprints(df.columns) if c in src.feature_columns(df.columns)]
    return df.select("compound_id", *found, "MW", "ALOGP")


@query("id_fallback", f"""WITH {sql.EXPERTS} SELECT CAST(compound_id AS VARCHAR) AS "SMILES", b AS "DELLabel" FROM scores""")
def id_fallback(spark, sf):
    scored = fx.expert_scores(spark, sf).withColumn("SMILES", F.col("compound_id").cast("string"))
    return scored.select(src.id_column(scored.columns), F.col("b").alias("DELLabel"))


@query(
    "fp_valid",
    f"""WITH {sql.COMPOUNDS} SELECT compound_id,
      CAST(fp_part IS NOT NULL AND len(string_split(fp_part, ',')) = 64 AS INT) AS part_valid,
      CAST(fp_supp IS NOT NULL AND len(string_split(fp_supp, ',')) = 32 AS INT) AS supp_valid FROM compounds""",
)
def fp_valid(spark, sf):
    return fx.compounds(spark, sf).select(
        "compound_id",
        fp.fp_is_valid("fp_part", PART).cast("int").alias("part_valid"),
        fp.fp_is_valid("fp_supp", SUPP).cast("int").alias("supp_valid"),
    )


@query(
    "fp_strict_rows",
    f"""WITH {sql.COMPOUNDS},
    dirty AS (SELECT compound_id, CASE WHEN compound_id % 7 = 0 THEN replace(fp_supp, '1', 'x') ELSE fp_supp END AS t FROM compounds),
    parsed AS (SELECT compound_id, list_transform(string_split(t, ','), lambda v: TRY_CAST(v AS INT)) AS v FROM dirty WHERE t IS NOT NULL)
    SELECT compound_id, CAST(list_sum(v) AS BIGINT) AS total FROM parsed
    WHERE len(list_filter(v, lambda e: e IS NULL)) = 0""",
)
def fp_strict_rows(spark, sf):
    dirty = fx.compounds(spark, sf).withColumn(
        "t", F.when(F.col("compound_id") % 7 == 0, F.replace("fp_supp", F.lit("1"), F.lit("x"))).otherwise(F.col("fp_supp"))
    )
    parsed = dirty.select("compound_id", fp.parse_lenient("t").alias("v")).where("v IS NOT NULL")
    total = F.aggregate("v", F.lit(0).cast("long"), lambda acc, e: acc + e)
    return parsed.select("compound_id", total.alias("total"))


@query(
    "fp_parse_eq1",
    f"""WITH {sql.COMPOUNDS},
    p AS (SELECT compound_id, CASE WHEN len(string_split(fp_supp, ',')) = 32 THEN string_split(fp_supp, ',') ELSE [] END AS v FROM compounds)
    SELECT compound_id, array_to_string(list_filter(range(32), lambda i: v[i + 1] = '1'), ',') AS positions FROM p""",
)
def fp_parse_eq1(spark, sf):
    return fx.compounds(spark, sf).select("compound_id", text(fp.on_positions("fp_supp", SUPP)).alias("positions"))


_ZEROS_32 = ",".join(["0"] * 32)


@query(
    "fp_parse_count",
    f"""WITH {sql.COMPOUNDS} SELECT compound_id,
    CASE WHEN len(string_split(fp_supp, ',')) = 32 THEN fp_supp ELSE '{_ZEROS_32}' END AS counts FROM compounds""",
)
def fp_parse_count(spark, sf):
    return fx.compounds(spark, sf).select("compound_id", text(fp.encode("fp_supp", SUPP, "count")).alias("counts"))


@query(
    "fp_int8",
    f"""WITH {sql.COMPOUNDS} SELECT compound_id, array_to_string(CAST(string_split(fp_part, ',') AS TINYINT[]), ',') AS v
    FROM compounds WHERE fp_part IS NOT NULL""",
)
def fp_int8(spark, sf):
    rows = profile.drop_missing(fx.compounds(spark, sf), ["fp_part"])
    return rows.select("compound_id", text(fp.parse_strict("fp_part", "tinyint")).alias("v"))


@query(
    "fp_pad_truncate",
    f"""WITH {sql.COMPOUNDS} SELECT compound_id,
    array_to_string(list_transform(range(40), lambda i: coalesce(string_split(fp_supp, ',')[i + 1], '0')), ',') AS padded,
    array_to_string(string_split(fp_part, ',')[1:48], ',') AS cut
    FROM compounds WHERE fp_part IS NOT NULL""",
)
def fp_pad_truncate(spark, sf):
    rows = profile.drop_missing(fx.compounds(spark, sf), ["fp_part"])
    return rows.select(
        "compound_id",
        text(fp.pad_or_truncate(fp.parse_strict("fp_supp"), 40)).alias("padded"),
        text(fp.pad_or_truncate(fp.parse_strict("fp_part"), 48)).alias("cut"),
    )


@query(
    "fp_concat",
    f"""WITH {sql.COMPOUNDS},
    v AS (SELECT compound_id, coalesce(string_split(fp_part, ','), list_transform(range(64), lambda i: '0')) AS p,
      CASE WHEN len(string_split(fp_supp, ',')) = 32 THEN string_split(fp_supp, ',') ELSE list_transform(range(32), lambda i: '0') END AS s
      FROM compounds)
    SELECT compound_id, CAST(96 AS INT) AS width,
      array_to_string(list_filter(range(96), lambda i: list_concat(p, s)[i + 1] = '1'), ',') AS positions FROM v""",
)
def fp_concat(spark, sf):
    df = fx.compounds_file(spark, sf)
    widths = fp.modal_widths(df, ["fp_part", "fp_supp"])
    encoder = fp.FingerprintEncoder(inputCols=list(widths), widths=list(widths.values()), outputCol="features")
    parts = F.unwrap_udt(F.col("features"))
    # a vector that is mostly ones would be stored dense, without indices
    on = F.coalesce(parts["indices"], F.filter(F.sequence(F.lit(0), F.lit(95)), lambda i: F.get(parts["values"], i) != 0))
    return encoder.transform(df).select(
        "compound_id", F.coalesce(parts["size"], F.size(parts["values"])).alias("width"), text(on).alias("positions")
    )


@query(
    "fp_ranges",
    f"""WITH {sql.COMPOUNDS}, e AS (
      SELECT 'fp_part' AS "column", CAST(unnest(string_split(fp_part, ',')) AS INT) AS v FROM compounds
      UNION ALL SELECT 'fp_supp', CAST(unnest(string_split(fp_supp, ',')) AS INT) FROM compounds)
    SELECT "column", MIN(v) AS min_value, MAX(v) AS max_value FROM e GROUP BY 1""",
)
def fp_ranges(spark, sf):
    return profile.fp_ranges(fx.compounds(spark, sf), ["fp_part", "fp_supp"])


_DESCRIBE = """COUNT(v) AS "count", ROUND(AVG(v), 4) AS mean, ROUND(STDDEV_SAMP(v), 4) AS std, CAST(MIN(v) AS DOUBLE) AS "min",
  ROUND(QUANTILE_CONT(v, 0.25), 6) AS q25, ROUND(QUANTILE_CONT(v, 0.5), 6) AS q50, ROUND(QUANTILE_CONT(v, 0.75), 6) AS q75, CAST(MAX(v) AS DOUBLE) AS "max" """


def _described(df):
    return rounded(rounded(df, "mean", "std", digits=4), "q25", "q50", "q75")


@query(
    "fp_lengths",
    f"""WITH {sql.COMPOUNDS}, l AS (
      SELECT 'fp_part' AS "column", CAST(len(string_split(fp_part, ',')) AS DOUBLE) AS v FROM compounds
      UNION ALL SELECT 'fp_supp', CAST(len(string_split(fp_supp, ',')) AS DOUBLE) FROM compounds)
    SELECT "column", {_DESCRIBE} FROM l GROUP BY 1""",
)
def fp_lengths(spark, sf):
    return _described(profile.fp_lengths(fx.compounds_file(spark, sf), ["fp_part", "fp_supp"]))


@query(
    "column_nulls",
    f"""WITH {sql.COMPOUNDS}, n AS (
      SELECT COUNT(*) AS r, COUNT(compound_id) AS c1, COUNT(label) AS c2, COUNT(fp_part) AS c3, COUNT(fp_supp) AS c4, COUNT(mw) AS c5 FROM compounds)
    SELECT u.col AS "column", u.nn AS non_nulls, r - u.nn AS nulls, ROUND((r - u.nn) * 100.0 / r, 6) AS null_pct FROM n,
    LATERAL (VALUES ('compound_id', c1), ('label', c2), ('fp_part', c3), ('fp_supp', c4), ('mw', c5)) u(col, nn)""",
)
def column_nulls(spark, sf):
    cols = ["compound_id", "label", "fp_part", "fp_supp", "mw"]
    return rounded(profile.column_nulls(fx.compounds(spark, sf), cols), "null_pct")


@query(
    "describe_numeric",
    f"""WITH l AS (
      SELECT 'o_custkey' AS "column", CAST(o_custkey AS DOUBLE) AS v FROM orders
      UNION ALL SELECT 'o_orderkey', CAST(o_orderkey AS DOUBLE) FROM orders
      UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders)
    SELECT "column", {_DESCRIBE} FROM l GROUP BY 1""",
)
def describe_numeric(spark, sf):
    return _described(profile.describe_numeric(fx.table(spark, sf, "orders")))


@query(
    "top_values",
    """WITH l AS (
      SELECT 'event_type' AS "column", event_type AS "value" FROM events
      UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events
      UNION ALL SELECT 'props', props FROM events),
    c AS (SELECT "column", "value", COUNT(*) AS n FROM l WHERE "value" IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, "value") AS INT) AS rank FROM c)
    SELECT * FROM r WHERE rank <= 5""",
)
def top_values(spark, sf):
    return profile.top_values(fx.table(spark, sf, "events"), ["event_type", "user_id", "props"], 5)


@query(
    "label_balance",
    """SELECT toxic, COUNT(*) AS n, ROUND(COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (), 6) AS share FROM labels GROUP BY toxic""",
)
def label_balance(spark, sf):
    return rounded(profile.label_balance(fx.table(spark, sf, "labels"), "toxic"), "share")


@query(
    "column_report",
    f"""WITH {sql.COMPOUNDS}, l AS (
      SELECT 'compound_id' AS "column", CAST(compound_id AS DOUBLE) AS v FROM compounds
      UNION ALL SELECT 'group_id', CAST(group_id AS DOUBLE) FROM compounds
      UNION ALL SELECT 'mw', mw FROM compounds UNION ALL SELECT 'alogp', alogp FROM compounds
      UNION ALL SELECT 'fp_part', CAST(len(string_split(fp_part, ',')) AS DOUBLE) FROM compounds
      UNION ALL SELECT 'fp_supp', CAST(len(string_split(fp_supp, ',')) AS DOUBLE) FROM compounds),
    d AS (SELECT "column", {_DESCRIBE} FROM l GROUP BY 1),
    y AS (SELECT string_agg(concat(label, '=', n), '; ' ORDER BY n DESC, label) AS t FROM (SELECT label, COUNT(*) AS n FROM compounds GROUP BY 1)),
    n AS (SELECT COUNT(*) AS r, COUNT(fp_part) AS c3, COUNT(fp_supp) AS c4 FROM compounds),
    cols AS (SELECT u.* FROM n, LATERAL (VALUES
      ('compound_id', 'bigint', 'numeric', r), ('group_id', 'bigint', 'numeric', r), ('label', 'int', 'label', r),
      ('fp_part', 'string', 'fingerprint', c3), ('fp_supp', 'string', 'fingerprint', c4),
      ('mw', 'double', 'numeric', r), ('alogp', 'double', 'numeric', r)) u("column", data_type, kind, non_nulls))
    SELECT cols."column", cols.non_nulls, n.r - cols.non_nulls AS nulls, ROUND((n.r - cols.non_nulls) * 100.0 / n.r, 6) AS null_pct,
      kind, data_type, d."count", d.mean, d.std, d."min", d.q25, d.q50, d.q75, d."max",
      CASE WHEN kind = 'label' THEN y.t END AS top_values
    FROM cols CROSS JOIN n CROSS JOIN y LEFT JOIN d ON d."column" = cols."column" """,
)
def column_report(spark, sf):
    report = profile.column_report(fx.compounds_file(spark, sf), ["fp_part", "fp_supp"], "label")
    return _described(rounded(report, "null_pct"))


@query("compound_id_parts", f"WITH {sql.COMPOUND_KEYS} SELECT del_id, library, bb1, bb2, bb3, CASE WHEN bb3 IS NULL THEN 2 ELSE 3 END AS cycles FROM parts")
def compound_ids(spark, sf):
    parts = compound_id_parts(F.col("del_id"))
    return fx.compound_keys(spark, sf).select("del_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "by_building_block",
    f"""WITH {sql.COMPOUND_KEYS}
    SELECT library, bb1, COUNT(*) AS n_compounds FROM parts GROUP BY library, bb1
    UNION ALL SELECT library, NULL, COUNT(*) FROM parts GROUP BY library""",
)
def by_building_block(spark, sf):
    parts = compound_id_parts(F.col("del_id"))
    keys = fx.compound_keys(spark, sf).select(parts["library"].alias("library"), parts["bb1"].alias("bb1"))
    by_library = profile.by_building_block(keys, ["library"])
    return profile.by_building_block(keys, ["library", "bb1"]).unionByName(
        by_library.withColumn("bb1", F.lit(None).cast("int"))
    )

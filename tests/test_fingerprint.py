import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from assaykit.functions import fingerprint as fp
from assaykit.functions.scalars import compound_id_parts, features_from_run_name

ROWS = [
    (0, None), (1, "1,2,0,1"), (2, "0,0,0,0"), (3, "1,1"), (4, ""), (5, "1,2,0,1"), (6, "0,-1,1,7"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, fp string")


def by_id(df, col="v"):
    return {r["id"]: r[col] for r in df.collect()}


def test_valid_and_length(rows):
    got = by_id(rows.select("id", fp.fp_is_valid("fp", 4).alias("v")))
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True}
    assert by_id(rows.select("id", fp.fp_length("fp").alias("v")))[0] is None


@pytest.mark.parametrize(
    "mode, first, last",
    [("eq1", [1, 0, 0, 1], [0, 0, 1, 0]), ("count", [1, 2, 0, 1], [0, -1, 1, 7]), ("nonzero", [1, 1, 0, 1], [0, 1, 1, 1])],
)
def test_encode_modes(rows, mode, first, last):
    got = by_id(rows.select("id", fp.encode("fp", 4, mode).alias("v")))
    assert got[1] == got[5] == first and got[6] == last
    assert got[0] == got[2] == got[3] == got[4] == [0, 0, 0, 0]


def test_positions(rows):
    got = by_id(rows.select("id", fp.on_positions("fp", 4).alias("v")))
    assert got == {0: [], 1: [0, 3], 2: [], 3: [], 4: [], 5: [0, 3], 6: [2]}
    assert by_id(rows.select("id", fp.on_positions("fp", 4, "nonzero").alias("v")))[6] == [1, 2, 3]


def test_malformed_is_skipped_or_raises(spark):
    df = spark.createDataFrame([(0, "1,x,0"), (1, "1,2,3"), (2, "1,,0")], "id long, fp string")
    assert by_id(df.select("id", fp.parse_lenient("fp").alias("v"))) == {0: None, 1: [1, 2, 3], 2: None}
    with pytest.raises(PySparkException):
        df.select(fp.parse_strict("fp").alias("v")).collect()


def test_int8_overflow_raises(spark):
    df = spark.createDataFrame([("1,300",)], "fp string")
    with pytest.raises(PySparkException):
        df.select(fp.parse_strict("fp", "tinyint").alias("v")).collect()


def test_pad_and_truncate(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "v array<int>")
    assert df.select(fp.pad_or_truncate(F.col("v"), 5)).first()[0] == [1, 2, 3, 0, 0]
    assert df.select(fp.pad_or_truncate(F.col("v"), 2)).first()[0] == [1, 2]


def test_modal_width(rows):
    assert fp.modal_widths(rows, ["fp"]) == {"fp": 4}
    with pytest.raises(ValueError, match="no fingerprint text"):
        fp.modal_widths(rows.where("id = 0"), ["fp"])


def test_unknown_mode(rows):
    with pytest.raises(ValueError, match="unknown fingerprint mode"):
        fp.encode("fp", 4, "bits")


def test_encoder_blocks_and_missing_column(spark, rows, tmp_path):
    two = rows.withColumn("other", F.lit("0,1"))
    stage = fp.FingerprintEncoder(inputCols=["fp", "other"], widths=[4, 2], outputCol="v", onMissing="zero")
    got = by_id(stage.transform(two))
    assert got[1].toArray().tolist() == [1, 0, 0, 1, 0, 1] and got[0].toArray().tolist() == [0, 0, 0, 0, 0, 1]
    # an absent first block is filled in place and the second keeps its position
    assert by_id(stage.transform(two.drop("fp")))[1].toArray().tolist() == [0, 0, 0, 0, 0, 1]
    strict = stage.copy({stage.onMissing: "error"})
    with pytest.raises(ValueError, match="missing"):
        strict.transform(two.drop("fp"))
    path = str(tmp_path / "model")
    PipelineModel([stage]).save(path)
    assert by_id(PipelineModel.load(path).transform(two)) == got
    assert Pipeline(stages=[stage]).fit(two).transform(two).count() == len(ROWS)


def test_compound_id_parts(spark):
    df = spark.createDataFrame([("L03-235-78-2253",), ("L01-123-45",), ("bad",)], "c string")
    parts = compound_id_parts(F.col("c"))
    got = [tuple(r) for r in df.select(*[v.alias(k) for k, v in parts.items()]).collect()]
    assert got == [("L03", 235, 78, 2253, 3), ("L01", 123, 45, None, 2), (None, None, None, None, None)]


def test_run_name(spark):
    df = spark.createDataFrame([("featsel__TOPTOR_ECFP6_20250701-101010",)], "r string")
    assert df.select(features_from_run_name(F.col("r"))).first()[0] == "TOPTOR, ECFP6"


def test_encoder_agrees_with_the_column_expression(rows, spark):
    for mode in fp.MODES:
        stage = fp.FingerprintEncoder(inputCols=["fp"], widths=[4], mode=mode, outputCol="v")
        vectors = {k: [int(x) for x in v.toArray()] for k, v in by_id(stage.transform(rows)).items()}
        assert vectors == by_id(rows.select("id", fp.encode("fp", 4, mode).alias("v")))
    bad = spark.createDataFrame([(0, "1,x,0,1")], "id long, fp string")
    with pytest.raises(PySparkException, match="malformed"):
        stage.transform(bad).collect()


@pytest.mark.parametrize("seed", range(4))
def test_batch_parser_against_single_texts(seed):
    rng = random.Random(seed)
    element = lambda: rng.choice(["0", "0", "0", "1", "7", "-3", "+4", "12", "-250", "007", " 5", "6 ", "999999999999999999"])
    texts = [None if rng.random() < 0.1 else ",".join(element() for _ in range(rng.choice([5, 5, 5, 4, 1]))) for _ in range(rng.choice([0, 1, 300]))]
    want = [(r, i, int(x)) for r, t in enumerate(texts) if t is not None and t.count(",") == 4 for i, x in enumerate(t.split(",")) if int(x)]
    for shift in (0, min(3, len(texts))):  # also a slice of a longer array
        column = pa.array(texts[:shift] + texts, pa.string())[shift:]
        assert list(zip(*(x.tolist() for x in fp.parse_batch(column, 5)))) == want
    assert [x.tolist() for x in fp.parse_batch(pa.array(["1", None, "0", "3", "1,1"]), 1)] == [[0, 3], [0, 0], [1, 3]]


@pytest.mark.parametrize("bad", ["1,x,0", "1,,0", ",1,1", "1,1,", "1,1.0,1", "1,-,1", "1,1 1,0", "1,\u0661,0", "1,1234567890123456789,0", "1, ,0", "a,0,0"])
def test_batch_parser_names_a_malformed_text(bad):
    with pytest.raises(ValueError, match="malformed"):
        fp.parse_batch(pa.array(["0,0,0", bad, None]), 3)


def test_encoder_over_several_batches(spark):
    texts = [",".join(str(int(x)) for x in np.random.default_rng(i).integers(0, 3, 70)) for i in range(50)]
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else t) for i, t in enumerate(texts)], "id long, a string, b string").coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        got = by_id(fp.FingerprintEncoder(inputCols=["a", "b"], widths=[70, 70], mode="count", outputCol="v").transform(df))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for i, t in enumerate(texts):
        one = [int(x) for x in t.split(",")]
        assert got[i].toArray().tolist() == one + ([0] * 70 if i % 7 == 0 else one)

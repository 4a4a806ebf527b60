"""Small column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0 where the denominator is 0."""
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(0.0))


def f1_score(precision: Column, recall: Column) -> Column:
    """Harmonic mean, 0 when both parts are 0."""
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def confidence(probability: Column, uncertainty: Column) -> Column:
    """Probability discounted by the disagreement of the experts."""
    return probability * (1 - uncertainty)


def similarity_to_distance(similarity: Column) -> Column:
    return 1 - similarity


def cosine(dot: Column, n_left: Column, n_right: Column) -> Column:
    """Cosine of two sets from their overlap and sizes."""
    return dot / F.sqrt(n_left.cast("double") * n_right)


def tanimoto(dot: Column, n_left: Column, n_right: Column) -> Column:
    return dot / (n_left + n_right - dot).cast("double")


def is_missing(c: str, data_type: str) -> Column:
    """Null, or NaN in a floating-point column."""
    null = F.col(c).isNull()
    return null | F.isnan(c) if data_type in ("double", "float") else null


def features_from_run_name(run: Column) -> Column:
    """``featsel__A_B_20250101-000000`` to ``A, B``."""
    part = F.split_part(run, F.lit("__"), F.lit(2))
    part = F.split_part(part, F.lit("_20"), F.lit(1))
    return F.replace(part, F.lit("_"), F.lit(", "))


# Fixed pattern of a compound id: library, then two or three building-block numbers.
COMPOUND_ID_PATTERN = r"^(L\d+)-(\d{1,4})-(\d{1,4})(?:-(\d{1,4}))?$"


def compound_id_parts(c: Column) -> dict[str, Column]:
    """Library, building blocks and number of cycles encoded in a compound id."""
    part = lambda i: F.nullif(F.regexp_extract(c, COMPOUND_ID_PATTERN, i), F.lit(""))
    library = part(1)
    return {
        "library": library,
        "bb1": part(2).cast("int"),
        "bb2": part(3).cast("int"),
        "bb3": part(4).cast("int"),
        "cycles": F.when(library.isNull(), None).when(part(4).isNull(), 2).otherwise(3),
    }

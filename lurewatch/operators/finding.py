"""How a finding is built, and how a rule that did not fire looks (NULL)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lurewatch.functions.arrays import string_array


def _col(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finding(
    category: str,
    severity: Column | str,
    title: Column | str,
    evidence: Column | str,
    location: Column | str,
    message: tuple[Column | str, Column | str],
    confidence: float = 1.0,
    tags: tuple[str, ...] = (),
) -> Column:
    description, recommendation = message
    return F.struct(
        _col(title).alias("title"),
        F.lit(category).alias("category"),
        _col(severity).alias("severity"),
        _col(description).alias("description"),
        _col(evidence).alias("evidence"),
        _col(recommendation).alias("recommendation"),
        _col(location).alias("location"),
        F.lit(float(confidence)).alias("confidence"),
        string_array(tags).alias("tags"),
    )

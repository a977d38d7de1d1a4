"""Long listings of links, attachments and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.functions.arrays import rows_of

DASH = "—"


def _or_dash(text: Column) -> Column:
    return F.when(text == "", DASH).otherwise(text)


def _flags(*named: tuple[Column, str]) -> Column:
    return _or_dash(F.concat_ws(" ", *[F.when(condition, F.lit(name)) for condition, name in named]))


def inspect_links(mail: DataFrame) -> DataFrame:
    return rows_of(mail, "email_id", item="links", pos="pos", name="l").select(
        "email_id",
        "pos",
        _or_dash(F.col("l.visible_text")).alias("text"),
        F.col("l.domain").alias("domain"),
        _flags(
            (F.col("l.is_ip_based"), "IP"),
            (F.col("l.is_shortened"), "Short"),
            (~F.col("l.uses_https"), "HTTP"),
            (F.col("l.is_punycode"), "Punycode"),
        ).alias("flags"),
    )


def inspect_attachments(mail: DataFrame) -> DataFrame:
    return rows_of(mail, "email_id", item="attachments", pos="pos", name="a").select(
        "email_id",
        "pos",
        F.col("a.filename").alias("filename"),
        F.col("a.extension").alias("extension"),
        F.expr("concat(format_number(a.size_bytes / 1024, '0.0'), ' KB')").alias("size"),
        _flags(
            (F.col("a.has_double_extension"), "Double ext"),
            (F.col("a.is_suspicious_type"), "Suspicious"),
        ).alias("flags"),
    )


def findings_long(analyzed: DataFrame) -> DataFrame:
    """One row per finding."""
    return rows_of(analyzed, "email_id", item="findings", name="f").select("email_id", "f.*")


def findings_listing(analyzed: DataFrame) -> DataFrame:
    f = findings_long(analyzed)
    return f.select(
        "email_id",
        "ordinal",
        F.upper("severity").alias("severity"),
        "title",
        F.replace("category", F.lit("_"), F.lit(" ")).alias("category"),
        "description",
        _or_dash(F.col("evidence")).alias("evidence"),
    )

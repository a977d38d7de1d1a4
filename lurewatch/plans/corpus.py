"""The whole job: parsed mails in, scored mails and scan tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lurewatch.operators.analysis import DEFAULT_ANALYZERS, Analyzer, run_analysis, score_mail
from lurewatch.operators.listing import DASH
from lurewatch.operators.mailfacts import normalize_mail
from lurewatch.rules import RuleSet
from lurewatch.sources.eml import content_key, file_name, parse_mail, scan_mail

FLAG_THRESHOLD = 50
#: Characters of a column that listings show.
SHOWN_LENGTHS = {"from_address": 25, "subject": 30, "error": 20, "text": 25, "description": 80, "evidence": 40}


def analyze_mail(
    parsed: DataFrame,
    rules: RuleSet | None = None,
    analyzers: Sequence[Analyzer] = DEFAULT_ANALYZERS,
) -> DataFrame:
    """Normalize, analyze and score parsed mails. Nothing here shuffles."""
    return score_mail(run_analysis(normalize_mail(parsed), rules, analyzers))


def analyze_raw(
    raw: DataFrame,
    rules: RuleSet | None = None,
    analyzers: Sequence[Analyzer] = DEFAULT_ANALYZERS,
) -> DataFrame:
    """The same from bytes (`path`, `length`, `content`), with `email_id` and `filename`."""
    if "email_id" not in raw.columns:
        raw = raw.withColumn("email_id", content_key())
    named = raw.withColumn("filename", file_name(F.col("path")))
    return analyze_mail(parse_mail(named), rules, analyzers)


def analyze_folder(spark: SparkSession, directory: str, rules: RuleSet | None = None) -> DataFrame:
    """Every mail file below a directory; the limits of the intake gate are for uploads only."""
    return analyze_raw(scan_mail(spark, directory), rules)


def corpus_scan(analyzed: DataFrame, threshold: float = FLAG_THRESHOLD) -> DataFrame:
    """One row per file; a file that could not be parsed is an ERROR row."""
    failed = F.col("parse_error").isNotNull()
    ok = lambda value, otherwise: F.when(failed, otherwise).otherwise(value)
    subject = F.when(F.col("subject") == "", DASH).otherwise(F.col("subject"))
    return analyzed.select(
        *(["path"] if "path" in analyzed.columns else []),
        "email_id",
        "filename",
        ok(F.col("from_address"), F.lit(DASH)).alias("from_address"),
        ok(subject, F.lit(DASH)).alias("subject"),
        ok(F.col("risk_score"), F.lit(None)).alias("risk_score"),
        ok(F.upper("risk_level"), F.lit("ERROR")).alias("risk_level"),
        ok(F.col("finding_count"), F.lit(None)).alias("finding_count"),
        F.col("parse_error").alias("error"),
        ok(F.col("risk_score") >= threshold, F.lit(False)).alias("flagged"),
    )


def shortened(listing: DataFrame) -> DataFrame:
    """A listing as a terminal shows it: long texts cut. Tables keep them whole."""
    present = {c: n for c, n in SHOWN_LENGTHS.items() if c in listing.columns}
    return listing.withColumns({c: F.substring(c, 1, n) for c, n in present.items()})


def scan_summary(scan: DataFrame) -> DataFrame:
    """How many files, how many above the threshold, how many failed."""
    return scan.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("flagged").alias("flagged"),
        F.count_if(F.col("risk_level") == "ERROR").alias("errors"),
    )

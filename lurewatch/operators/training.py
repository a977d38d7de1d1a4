"""Labelled samples and quiz grading."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lurewatch.functions.arrays import join_splittable
from lurewatch.rules.fixed import QUIZ_GRADES

SAMPLE_SCHEMA = (
    "id string, title string, description string, eml_filename string, is_phishing boolean, "
    "difficulty string, explanation string, indicators array<string>, tags array<string>"
)
DEFAULT_DIFFICULTY = "beginner"


def load_samples(spark: SparkSession, manifest: str | Path) -> DataFrame:
    """The samples of a YAML manifest; none if the file is missing."""
    import yaml

    path = Path(manifest)
    entries = []
    if path.exists():
        entries = (yaml.safe_load(path.read_text(encoding="utf-8")) or {}).get("samples", [])
    rows = [
        (
            e["id"], e["title"], e.get("description", ""), e["eml_filename"], bool(e["is_phishing"]),
            e.get("difficulty", DEFAULT_DIFFICULTY), e.get("explanation", ""),
            list(e.get("indicators") or []), list(e.get("tags") or []),
        )
        for e in entries
    ]
    return spark.createDataFrame(rows, SAMPLE_SCHEMA)


def sample_by_id(samples: DataFrame, sample_id: str) -> DataFrame:
    return samples.filter(F.col("id") == sample_id)


def sample_listing(samples: DataFrame) -> DataFrame:
    """What a learner may see: no label, no explanation."""
    return samples.select("id", "title", "description", "difficulty", "tags")


def grade(answers: DataFrame, samples: DataFrame) -> DataFrame:
    """Add `correct`, `explanation` and `indicators` to `(sample_id, user_answer, ...)`.

    Answers pile up on popular samples: Catalyst broadcasts the samples when they
    are small, and adaptive execution splits a hot sample's answers when they are
    not, however the samples were made.
    """
    key = samples.select(
        F.col("id").alias("sample_id"),
        F.col("is_phishing").alias("_label"),
        F.col("explanation").alias("_explanation"),
        F.col("indicators").alias("_indicators"),
    )
    known = F.col("_label").isNotNull()
    return join_splittable(answers, key, "sample_id").select(
        *answers.columns,
        F.coalesce(F.col("user_answer") == F.col("_label"), F.lit(False)).alias("correct"),
        F.when(known, F.col("_explanation"))
        .otherwise(F.concat(F.lit("Unknown sample ID: "), F.col("sample_id").cast("string")))
        .alias("explanation"),
        F.coalesce("_indicators", F.array().cast("array<string>")).alias("indicators"),
    )


def score_percent(correct: Column, total: Column) -> Column:
    """Percent to one decimal, ties to even, 0.0 without answers."""
    return F.when(total > 0, F.bround(correct / total * 100, 1)).otherwise(0.0)


def quiz_score(graded: DataFrame, *by: str) -> DataFrame:
    """Totals over all answers, or per group: `(by..., total, correct, incorrect, score_percent)`."""
    counts = graded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("correct")).alias("correct")
    )
    return counts.select(
        *by,
        "total",
        "correct",
        (F.col("total") - F.col("correct")).alias("incorrect"),
        score_percent(F.col("correct"), F.col("total")).alias("score_percent"),
    )


def quiz_score_with_total(graded: DataFrame, by: str) -> DataFrame:
    """Totals per group and, where `of_all` is true, over all answers; the answers are read once.

    A group whose key is NULL stays apart from the total.
    """
    counts = graded.rollup(by).agg(
        (F.grouping(by) == 1).alias("of_all"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("correct")).alias("correct"),
    )
    return counts.select(
        by,
        "of_all",
        "total",
        "correct",
        (F.col("total") - F.col("correct")).alias("incorrect"),
        score_percent(F.col("correct"), F.col("total")).alias("score_percent"),
    )


def quiz_verdict(percent: Column) -> Column:
    return F.coalesce(*[F.when(percent >= bound, F.lit(text)) for bound, text in QUIZ_GRADES])


def mail_of_samples(samples: DataFrame, mail: DataFrame) -> DataFrame:
    """The mails that are samples, before anything costly is done with them; both have `eml_filename`."""
    return mail.join(samples.select("eml_filename"), "eml_filename", "left_semi")


def sample_analysis(samples: DataFrame, analyzed: DataFrame) -> DataFrame:
    """The rules' outcome beside each sample's label; `analyzed` has `eml_filename`."""
    outcome = analyzed.select(
        "eml_filename", "risk_score", "risk_level", "finding_count", "findings",
        "category_scores", "top_contributors",
    )
    return samples.select("id", "eml_filename", "is_phishing").join(outcome, "eml_filename").drop(
        "eml_filename"
    )


def sample_detail(samples: DataFrame, mail: DataFrame) -> DataFrame:
    """Samples with their normalized mail; `mail` has `eml_filename`."""
    shown = mail.select(
        "eml_filename", "subject", "from_address", "from_display_name", "reply_to", "return_path",
        "to", "date_raw", "text_body", "authentication_results",
        F.size("links").alias("link_count"),
        F.size("attachments").alias("attachment_count"),
        F.transform(
            "links",
            lambda l: F.struct(
                *[l[n].alias(n) for n in (
                    "visible_text", "href", "domain", "is_ip_based", "is_shortened", "uses_https")]
            ),
        ).alias("links"),
        F.transform(
            "attachments",
            lambda a: F.struct(
                *[a[n].alias(n) for n in (
                    "filename", "extension", "size_bytes", "has_double_extension",
                    "is_suspicious_type")]
            ),
        ).alias("attachments"),
    )
    return samples.select(
        "id", "title", F.col("description"), "difficulty", "tags", "eml_filename"
    ).join(shown, "eml_filename").drop("eml_filename")

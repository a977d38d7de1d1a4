"""What the plans must look like, so that they hold at scale."""

from __future__ import annotations

import contextlib
import io

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lurewatch.operators import intel, training
from lurewatch.plans import catalog
from lurewatch.plans.corpus import analyze_mail, analyze_raw, corpus_scan
from lurewatch.sources import derived, store
from lurewatch.sources.derived import table


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def stored_mail(spark, tmp_path):
    """Mails already in the parsed shape, as a table."""
    path = str(tmp_path / "parsed")
    derived.mail(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


def test_analysis_never_shuffles(spark, tmp_path):
    p = plan(analyze_mail(stored_mail(spark, tmp_path)))
    assert "Exchange" not in p and "Join" not in p and "Python" not in p and "MapInArrow" not in p


def test_analysis_reads_what_it_needs(spark, tmp_path):
    scan = corpus_scan(analyze_mail(stored_mail(spark, tmp_path)).withColumn("filename", catalog.F.lit("x")))
    schema = next(line for line in plan(scan).splitlines() if "ReadSchema" in line)
    for unused in ("cc:", "html_body", "received_hops"):
        assert unused not in schema


def test_bytes_cross_to_python_once(spark, tmp_path):
    raw = derived.raw_mail(spark, SMALL)
    path = str(tmp_path / "raw")
    raw.write.parquet(path)
    p = plan(corpus_scan(analyze_raw(spark.read.parquet(path))))
    assert p.count("MapInArrow\n") == 1 and "Exchange" not in p


def test_header_rules_read_no_text(spark):
    for name in ("hdr_return_path_mismatch", "snd_display_impersonation", "auth_spf"):
        p = plan(catalog.queries()[name](spark, SMALL))
        assert "ReadSchema: struct<doc_id:bigint>" in p and "Exchange" not in p


def test_body_is_lowered_once(spark):
    """Catalyst must not move `lower(body)` into the loop over phrases."""
    p = plan(catalog.queries()["txt_signals"](spark, SMALL))
    body_loops = [line for line in p.splitlines() if "lambdafunction" in line and "lower(concat_ws" in line]
    assert body_loops == []


@pytest.fixture
def skewed(spark):
    """Settings under which a hot key of a small table shows."""
    hot = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in hot}
    for k, v in hot.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def final_plan(frame) -> str:
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_hot_sample_is_split(skewed):
    answers = skewed.range(0, 20000, 1, 8).select(
        "id", F.when(F.col("id") % 5 > 0, 1).otherwise(F.col("id")).alias("sample_id"), F.lit(True).alias("user_answer")
    )
    ids = skewed.range(500)
    samples = ids.join(skewed.range(400), "id").select(
        "id", (F.col("id") % 2 == 0).alias("is_phishing"), F.lit("e").alias("explanation"),
        F.array(F.lit("i")).alias("indicators"),
    )
    graded = training.grade(answers, samples)
    assert "skew=true" in final_plan(graded)
    assert graded.count() == 20000


def test_hot_hash_is_split(skewed):
    item = F.struct(
        F.lit("f").alias("filename"), F.when(F.col("id") % 5 > 0, "hot").otherwise(F.col("id").cast("string")).alias("sha256")
    )
    mail = skewed.range(0, 20000, 1, 8).select(F.col("id").alias("email_id"), F.array(item).alias("attachments"))
    verdicts = skewed.range(100).groupBy(F.col("id").cast("string").alias("sha256")).agg(
        *[F.lit(1).alias(v) for v in ("malicious", "suspicious", "harmless", "undetected")]
    ).withColumn("tags", F.array(F.lit("t")))
    judged = intel.hash_verdicts(mail, verdicts)
    assert "skew=true" in final_plan(judged)
    assert judged.count() == 20000


def test_samples_are_chosen_before_the_analysis(spark):
    p = plan(catalog.queries()["sample_analysis"](spark, SMALL))
    assert "LeftSemi" in p

"""The thirteen mails end to end: bytes to score."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import listing
from lurewatch.plans.corpus import analyze_folder, analyze_raw, corpus_scan, scan_summary
from mails import MAILS, OUTCOMES


@pytest.fixture(scope="module")
def results(spark):
    rows = [(f"/mails/{n}.eml", None, len(b), bytearray(b)) for n, b in MAILS.items()]
    raw = spark.createDataFrame(
        rows, "path string, modificationTime timestamp, length bigint, content binary"
    )
    return {r.filename[:-4]: r for r in analyze_raw(raw).collect()}


@pytest.mark.parametrize("name", list(OUTCOMES))
def test_outcome(results, name):
    findings, raw, score, level, categories = OUTCOMES[name]
    r = results[name]
    assert r.parse_error is None
    assert r.finding_count == len(r.findings) == findings, [f.title for f in r.findings]
    assert sum(c.score for c in r.category_scores) == raw
    assert r.risk_score == score
    assert r.risk_level == level
    assert {c.category: (c.score, c.finding_count) for c in r.category_scores} == categories
    assert [c.category for c in r.category_scores] == sorted(categories)
    assert [f.ordinal for f in r.findings] == list(range(1, findings + 1))
    assert len({f.id for f in r.findings}) == findings


def test_top_contributors_keep_finding_order(results):
    assert results["phishing_links"].top_contributors == [
        "Multiple authentication failures",
        "Link text domain differs from actual URL",
        "Return-Path domain mismatch",
        "Display name impersonation",
        "SPF check failed",
    ]


def test_folder_scan_with_a_broken_mail(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("simple", "phishing_links"):
        (tmp_path / "deep" / f"{name}.eml").write_bytes(MAILS[name])
    (tmp_path / "other.txt").write_text("no mail")
    (tmp_path / "broken.eml").write_bytes(
        b"From: a@b.example\nContent-Type: text/html\n\n<a href='http://[bad/x'>x</a>"
    )
    scan = corpus_scan(analyze_folder(spark, str(tmp_path)))
    rows = {r.filename: r for r in scan.collect()}
    assert set(rows) == {"simple.eml", "phishing_links.eml", "broken.eml"}
    assert rows["phishing_links.eml"].flagged and not rows["simple.eml"].flagged
    assert rows["broken.eml"].risk_level == "ERROR" and rows["broken.eml"].risk_score is None
    assert rows["broken.eml"].error == "Invalid IPv6 URL"
    summary = scan_summary(scan).first()
    assert (summary.files, summary.flagged, summary.errors) == (3, 1, 1)


def test_folder_scan_loses_no_mail(spark, tmp_path):
    for name in ("a.eml", "_b.eml", ".c.eml", "_sub/d.eml", "sub/a.eml", ".hidden/e.eml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(MAILS["simple"])
    (tmp_path / "big.eml").write_bytes(MAILS["simple"] + b"x" * (11 * 1024 * 1024))
    rows = corpus_scan(analyze_folder(spark, str(tmp_path))).collect()
    assert sorted(os.path.relpath(r.path, tmp_path) for r in rows) == sorted(
        ["a.eml", "_b.eml", ".c.eml", "_sub/d.eml", "sub/a.eml", ".hidden/e.eml", "big.eml"]
    )
    assert len({r.email_id for r in rows}) == len(rows)
    assert analyze_folder(spark, str(tmp_path / "_sub")).count() == 1


def test_an_unknown_severity_fails(spark, tmp_path):
    from lurewatch.operators.analysis import severity_points
    from lurewatch.rules import RuleSet

    (tmp_path / "content_patterns.yml").write_text("urgent:\n  severity: severe\n  patterns: [x]\n")
    with pytest.raises(ValueError, match="content_patterns.yml, urgent"):
        RuleSet.from_directory(tmp_path)
    for severity in (F.lit("severe"), F.lit(None).cast("string")):
        with pytest.raises(Exception, match="unknown severity"):
            spark.range(1).select(severity_points(severity)).collect()


@pytest.mark.parametrize("unit", ["<b>x", "<a href=u>y"])
def test_open_elements_cost_no_more_than_input_and_output(unit):
    from lurewatch.sources import html

    def seconds(n):
        start = time.process_time()
        try:
            html.read_html(unit * n)
        except ValueError as error:
            assert "link text" in str(error)
        return time.process_time() - start

    small = min(seconds(5_000) for _ in range(3))
    assert seconds(100_000) < 60 * max(small, 0.01)


def test_long_and_nested_scores_agree(spark):
    from conftest import SMALL
    from lurewatch.operators.analysis import severity_points
    from lurewatch.plans.corpus import analyze_mail
    from lurewatch.sources import derived

    analyzed = analyze_mail(derived.mail(spark, SMALL)).select(
        "email_id", "risk_score", "findings"
    )
    long = listing.findings_long(analyzed).groupBy("email_id").agg(
        F.least(F.lit(100), F.sum(severity_points(F.col("severity")))).cast("double").alias("total")
    )
    differ = analyzed.join(long, "email_id", "left").filter(
        F.col("risk_score") != F.coalesce("total", F.lit(0.0))
    )
    assert differ.count() == 0

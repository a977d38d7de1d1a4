"""Reputation lookups as joins with verdict tables.

Verdict tables hold what a reputation service answered, keyed by domain, URL id
or file hash: counts `malicious`, `suspicious`, `harmless`, `undetected`, plus
`reputation` and `categories` where the service gives them. They may be large,
so no side is forced to be broadcast. Keys are made distinct before the join:
a domain that a third of all links share crosses the shuffle once per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.functions.arrays import join_splittable, rows_of
from lurewatch.functions.urls import base64_url_id
from lurewatch.rules.fixed import (
    HASH_TAG_LIMIT,
    MALICIOUS_MIN,
    SUSPICIOUS_MALICIOUS_MIN,
    SUSPICIOUS_VOTES_MIN,
)
from lurewatch.session import shared_folder

VOTES = ("malicious", "suspicious", "harmless", "undetected")


def is_malicious() -> Column:
    return F.col("malicious") >= MALICIOUS_MIN


def is_suspicious() -> Column:
    return (F.col("malicious") >= SUSPICIOUS_MALICIOUS_MIN) | (
        F.col("suspicious") >= SUSPICIOUS_VOTES_MIN
    )


def detection_ratio() -> Column:
    return F.when(F.col("total") == 0, "0/0").otherwise(
        F.concat(F.col("malicious").cast("string"), F.lit("/"), F.col("total").cast("string"))
    )


def _judge(joined: DataFrame, with_suspicious: bool = True) -> DataFrame:
    """Turn looked-up counts into verdict columns; a key without a row is not found."""
    counts = {v: F.coalesce(F.col(v), F.lit(0)) for v in VOTES}
    judged = (
        joined.withColumn("found", F.col("malicious").isNotNull())
        .withColumns(counts)
        .withColumn("total", sum((F.col(v) for v in VOTES[1:]), F.col(VOTES[0])))
    )
    status = F.when(~F.col("found"), "Not found").when(is_malicious(), "MALICIOUS")
    if with_suspicious:
        status = status.when(is_suspicious(), "Suspicious")
    return judged.withColumns(
        {
            "is_malicious": is_malicious(),
            "is_suspicious": is_suspicious(),
            "detection_ratio": detection_ratio(),
            "status": status.otherwise("Clean"),
        }
    )


def domain_verdicts(mail: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per distinct link domain."""
    domains = (
        rows_of(mail, item="links", name="l")
        .select(F.col("l.domain").alias("domain"))
        .filter("domain <> ''")
        .distinct()
    )
    return _judge(domains.join(verdicts, "domain", "left"))


def url_verdicts(mail: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per distinct link; `verdicts` is keyed by `url_id`."""
    urls = _distinct_hrefs(mail).withColumn("url_id", base64_url_id(F.col("url")))
    return _judge(urls.join(verdicts, "url_id", "left")).withColumns(
        {
            "reputation": F.coalesce("reputation", F.lit(0)),
            "categories": F.coalesce("categories", F.array().cast("array<string>")),
        }
    )


def hash_verdicts(mail: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per attachment with a hash; `verdicts` has one row per `sha256`, with `tags`.

    Copies of one file can be a large share of all attachments. They meet the
    verdicts in one join whose two sides are both dealt out for it, so adaptive
    execution can split the hot hash.
    """
    files = (
        rows_of(mail, "email_id", item="attachments", pos="pos", name="a")
        .select("email_id", "pos", F.col("a.filename").alias("filename"), F.col("a.sha256").alias("sha256"))
        .filter("sha256 <> ''")
    )
    return _judge(join_splittable(files, verdicts, "sha256"), with_suspicious=False).withColumn(
        "categories",
        F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, HASH_TAG_LIMIT),
    ).drop("tags")


def url_threats(mail: DataFrame, threats: DataFrame) -> DataFrame:
    """One row per distinct link against a threat list `(url, threat)`.

    Threat kinds are few, so the kinds gathered per URL stay few as well,
    however often a URL is listed.
    """
    listed = threats.groupBy("url").agg(F.array_sort(F.collect_set("threat")).alias("threats"))
    return (
        _distinct_hrefs(mail)
        .join(listed, "url", "left")
        .withColumn("threats", F.coalesce("threats", F.array().cast("array<string>")))
        .withColumn("safe", F.size("threats") == 0)
        .withColumn("is_dangerous", F.size("threats") > 0)
        .withColumn("status", F.when(F.col("safe"), "Safe").otherwise("DANGEROUS"))
    )


def _distinct_hrefs(mail: DataFrame) -> DataFrame:
    return (
        rows_of(mail, item="links", name="l")
        .select(F.col("l.href").alias("url"))
        .filter("url <> ''")
        .distinct()
    )


#: Fixed by the services: URLs a call takes, seconds between calls, and calls a day.
URLS_PER_CALL, CALL_SECONDS, CALLS_PER_DAY = 500, 15, 500


def url_calls(
    urls: DataFrame, per_call: int = URLS_PER_CALL, seconds: int = CALL_SECONDS, per_day: int = CALLS_PER_DAY
) -> DataFrame:
    """(url, call, place, day, second): which call asks for each distinct URL, and when it may be made.

    Calls are full but the last, in order of URL; `second` counts from the start of `day`, both from 0.
    URLs are numbered without a gap by counts per sorted part: the driver sees one number a
    part, and no task sees more than its own.
    """
    spark = urls.sparkSession
    target = shared_folder(spark, "urls")
    ordered = urls.select("url").filter("url <> ''").distinct().repartitionByRange("url").sortWithinPartitions("url")
    # the id holds the part in its high bits and the place within it in the low 33
    ordered.withColumn("at", F.monotonically_increasing_id()).write.parquet(target)
    numbered = spark.read.schema("url string, at bigint").parquet(target).withColumn("part", F.shiftright("at", 33))
    counts = {r.part: r.n for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    starts = spark.createDataFrame(offsets, "part bigint, before bigint")
    number = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    called = numbered.join(F.broadcast(starts), "part").select("url", number.alias("n"))
    call = F.floor(F.col("n") / per_call)
    return called.select(
        "url", call.alias("call"), (F.col("n") % per_call).cast("int").alias("place"),
        F.floor(call / per_day).alias("day"), ((call % per_day) * seconds).cast("int").alias("second"),
    )

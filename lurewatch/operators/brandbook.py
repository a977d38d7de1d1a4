"""Look-alike domains against a table of brands of any size.

Two labels are within two letters of each other only if deleting up to two letters from
each gives a common string. So both sides give their variants, an equi-join on them
proposes pairs, and the edit distance verifies. A brand inside a label is a piece of
it: labels with a keyword give their pieces of the lengths brands have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.operators.domains import domain_label, has_domain_keyword
from lurewatch.rules import RuleSet
from lurewatch.rules.fixed import MAX_BRAND_DISTANCE

HIT = "struct<idx:int,name:string,brand_domain:string,brand_label:string,distance:int>"


def brand_table(spark, rules: RuleSet) -> DataFrame:
    """The brands of a rule set as rows: (idx, domain, name, label)."""
    rows = [(i, b.domain, b.name, b.label) for i, b in enumerate(rules.brands)]
    return spark.createDataFrame(rows, "idx int, domain string, name string, label string")


def _shorter(words: Column) -> Column:
    """The words, and each of them without one of its letters."""

    def without(word: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(word))
        cut = lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1))
        return F.when(word == "", F.array().cast("array<string>")).otherwise(F.transform(places, cut))

    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, without))))


def variants(label: Column, letters: int = MAX_BRAND_DISTANCE) -> Column:
    """The label with up to so many letters deleted."""
    found = F.array(label)
    for _ in range(letters):
        found = _shorter(found)
    return found


def brand_hits(domains: DataFrame, brands: DataFrame) -> DataFrame:
    """(domain, hit) for distinct domains: the first brand in order of `idx` that one resembles, or NULL.

    Both sides are made distinct, so a domain of many mails is matched once.
    """
    distinct = domains.select("domain").distinct().withColumn("label", domain_label(F.col("domain")))
    labels = distinct.select("label").distinct()
    marks = brands.select(F.col("label").alias("brand_label")).distinct()
    near = labels.select("label", F.explode(variants(F.col("label"))).alias("variant")).join(
        marks.select("brand_label", F.explode(variants(F.col("brand_label"))).alias("variant")), "variant"
    )
    distance = F.levenshtein("label", "brand_label", MAX_BRAND_DISTANCE)
    near = near.select("label", "brand_label").distinct().withColumn("distance", distance)
    near = near.filter(F.col("distance").between(1, MAX_BRAND_DISTANCE))
    # every start and length of a piece
    starts = F.sequence(F.lit(1), F.length("label"))
    pieces = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(F.sequence(F.lit(1), F.length("label") - i + 1), lambda n: F.substr(F.col("label"), i, n)),
        )
    )
    keyed = labels.filter((F.col("label") != "") & has_domain_keyword(F.col("label")))
    # an empty brand label is in every other
    inside = keyed.select("label", F.explode(F.array_union(pieces, F.array(F.lit("")))).alias("brand_label")).join(marks, "brand_label")
    inside = inside.filter("label <> brand_label").withColumn("distance", distance)
    pairs = near.unionByName(inside).distinct().join(brands.withColumnRenamed("label", "brand_label"), "brand_label")
    hit = F.struct("idx", "name", F.col("domain").alias("brand_domain"), "brand_label", "distance").cast(HIT)
    first = pairs.groupBy("label").agg(F.min(hit).alias("hit"))
    return distinct.join(first, "label", "left").select("domain", "hit")

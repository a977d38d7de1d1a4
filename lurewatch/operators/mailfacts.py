"""From a parsed mail to a normalized one: links, attachments, sender domains.

Everything here is computed inside the row of the mail, so no step shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lurewatch.functions.files import file_facts
from lurewatch.functions.text import domain_of_address, strip
from lurewatch.functions.urls import link_facts, urls_in_text


def with_link_candidates(mail: DataFrame) -> DataFrame:
    """Add `link_candidates`: anchors that lead somewhere, then URLs in the text."""
    anchors = F.filter(
        F.transform(
            "anchors",
            lambda a: F.struct(
                a["visible_text"].alias("visible_text"),
                strip(a["href"]).alias("href"),
                F.lit(False).alias("from_text"),
            ),
        ),
        lambda a: (a["href"] != "") & ~a["href"].startswith("mailto:") & ~a["href"].startswith("#"),
    )
    written = F.transform(
        urls_in_text(F.col("text_body")),
        lambda u: F.struct(
            u.alias("visible_text"), u.alias("href"), F.lit(True).alias("from_text")
        ),
    )
    return mail.withColumn("link_candidates", F.concat(anchors, written))


def with_distinct_links(mail: DataFrame) -> DataFrame:
    """Keep the first candidate per href as `distinct_links`, in order.

    Sort by (href, position), keep the head of each run, sort back: n log n in
    the number of links, so a mail made of links alone stays cheap.
    """
    by_href = F.array_sort(
        F.transform(
            "link_candidates",
            lambda l, i: F.struct(
                l["href"].alias("href"),
                i.alias("pos"),
                l["visible_text"].alias("visible_text"),
                l["from_text"].alias("from_text"),
            ),
        )
    )
    mail = mail.withColumn("_by_href", by_href)
    runs = F.filter(
        "_by_href",
        lambda l, i: (i == 0) | (F.get(F.col("_by_href"), i - 1)["href"] != l["href"]),
    )
    in_order = F.array_sort(
        F.transform(
            runs,
            lambda l: F.struct(
                l["pos"].alias("pos"),
                l["visible_text"].alias("visible_text"),
                l["href"].alias("href"),
                l["from_text"].alias("from_text"),
            ),
        )
    )
    return mail.withColumn(
        "distinct_links",
        F.transform(in_order, lambda l: l.dropFields("pos")),
    ).drop("_by_href", "link_candidates")


def with_links(mail: DataFrame) -> DataFrame:
    """Add `links`, the distinct links of a mail with all their parts and flags."""
    mail = with_distinct_links(with_link_candidates(mail))
    return mail.withColumn("links", link_facts(F.col("distinct_links"))).drop("distinct_links")


def with_attachments(mail: DataFrame) -> DataFrame:
    return mail.withColumn("attachments", file_facts(F.col("files")))


def with_sender_domains(mail: DataFrame) -> DataFrame:
    return mail.withColumns(
        {
            "from_domain": domain_of_address(F.col("from_address")),
            "reply_domain": domain_of_address(F.col("reply_to")),
            "return_domain": domain_of_address(F.col("return_path")),
        }
    )


def normalize_mail(parsed: DataFrame) -> DataFrame:
    """The normalized mail; one with an unreadable link is marked as failed."""
    mail = with_attachments(with_links(parsed)).drop("anchors", "files")
    unreadable = F.exists("links", lambda l: l["is_malformed"])
    return mail.withColumn(
        "parse_error",
        F.coalesce(F.col("parse_error"), F.when(unreadable, F.lit("Invalid IPv6 URL"))),
    )

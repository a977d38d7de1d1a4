"""Header rules. Each is a finding column over one mail, NULL when it holds off."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lurewatch.functions.text import fill
from lurewatch.operators.finding import finding
from lurewatch.rules.messages import MESSAGES

CATEGORY = "sender_identity"


def _differs(domain: Column) -> Column:
    sender = F.col("from_domain")
    return (domain != "") & (sender != "") & (domain != sender)


def reply_to_mismatch() -> Column:
    domain = F.col("reply_domain")
    return F.when(
        _differs(domain),
        finding(
            CATEGORY,
            "medium",
            "Reply-To domain mismatch",
            fill("From domain: {}, Reply-To domain: {}", F.col("from_domain"), domain),
            "Reply-To header",
            MESSAGES["reply_to"],
        ),
    )


def return_path_mismatch() -> Column:
    domain = F.col("return_domain")
    return F.when(
        _differs(domain),
        finding(
            CATEGORY,
            "high",
            "Return-Path domain mismatch",
            fill("From domain: {}, Return-Path domain: {}", F.col("from_domain"), domain),
            "Return-Path header",
            MESSAGES["return_path"],
        ),
    )


def missing_message_id() -> Column:
    return F.when(
        F.col("message_id") == "",
        finding(
            CATEGORY,
            "low",
            "Missing Message-ID",
            "Message-ID header is absent",
            "Message-ID header",
            MESSAGES["no_message_id"],
        ),
    )


def message_id_mismatch() -> Column:
    """Fires unless the Message-ID domain is the sender's or one below it."""
    sender = F.col("from_domain")
    issued_by = F.lower(F.regexp_extract("message_id", r"@([^>]+)>?$", 1))
    return F.when(
        (sender != "")
        & (issued_by != "")
        & (issued_by != sender)
        & ~issued_by.endswith(F.concat(F.lit("."), sender)),
        finding(
            CATEGORY,
            "low",
            "Message-ID domain mismatch",
            fill("From domain: {}, Message-ID domain: {}", sender, issued_by),
            "Message-ID header",
            MESSAGES["message_id"],
            confidence=0.5,
        ),
    )


def bad_date() -> Column:
    return F.when(
        F.col("date").isNull(),
        finding(
            CATEGORY,
            "low",
            "Missing or invalid Date header",
            fill("Raw Date value: '{}'", F.col("date_raw")),
            "Date header",
            MESSAGES["bad_date"],
        ),
    )


HEADER_RULES = {
    "hdr_reply_to_mismatch": reply_to_mismatch,
    "hdr_return_path_mismatch": return_path_mismatch,
    "hdr_missing_message_id": missing_message_id,
    "hdr_message_id_mismatch": message_id_mismatch,
    "hdr_bad_date": bad_date,
}

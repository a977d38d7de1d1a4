"""Rules on the Authentication-Results header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.functions.text import fill
from lurewatch.operators.finding import finding
from lurewatch.rules.messages import MESSAGES

CATEGORY = "authentication"
LOCATION = "Authentication-Results header"


def with_auth_results(mail: DataFrame) -> DataFrame:
    """Add `spf`, `dkim`, `dmarc`: the first value of each, lower case, or ''."""
    header = F.col("authentication_results")
    return mail.withColumns(
        {
            mechanism: F.lower(
                F.regexp_extract(header, rf"(?iU){mechanism}{r'\s*=\s*(\w+)'}", 1)
            )
            for mechanism in ("spf", "dkim", "dmarc")
        }
    )


def missing() -> Column:
    return F.when(
        F.col("authentication_results") == "",
        finding(
            CATEGORY,
            "medium",
            "Missing Authentication-Results",
            "Authentication-Results header is absent",
            LOCATION,
            MESSAGES["auth_missing"],
            confidence=0.7,
        ),
    )


def _outcome(mechanism: str, result: str, severity: str, title: str, message: str, confidence=1.0):
    return (
        F.col(mechanism) == result,
        finding(
            CATEGORY,
            severity,
            title,
            f"{mechanism}={result}",
            LOCATION,
            MESSAGES[message],
            confidence=confidence,
        ),
    )


def _first(*outcomes) -> Column:
    return F.coalesce(*[F.when(condition, found) for condition, found in outcomes])


def spf() -> Column:
    return _first(
        _outcome("spf", "fail", "high", "SPF check failed", "spf_fail"),
        _outcome("spf", "softfail", "medium", "SPF soft fail", "spf_softfail"),
        _outcome("spf", "none", "low", "No SPF record", "spf_none", 0.6),
    )


def dkim() -> Column:
    return _first(
        _outcome("dkim", "fail", "high", "DKIM verification failed", "dkim_fail"),
        _outcome("dkim", "none", "low", "No DKIM signature", "dkim_none", 0.5),
    )


def dmarc() -> Column:
    return _first(
        _outcome("dmarc", "fail", "high", "DMARC check failed", "dmarc_fail"),
        _outcome("dmarc", "none", "low", "No DMARC policy", "dmarc_none", 0.5),
    )


def multiple_failures() -> Column:
    return F.when(
        (F.col("spf") == "fail") & (F.col("dmarc") == "fail"),
        finding(
            CATEGORY,
            "critical",
            "Multiple authentication failures",
            fill("spf={}, dmarc={}", F.col("spf"), F.col("dmarc")),
            LOCATION,
            MESSAGES["auth_multi"],
        ),
    )


AUTH_RULES = {
    "auth_missing": missing,
    "auth_spf": spf,
    "auth_dkim": dkim,
    "auth_dmarc": dmarc,
    "auth_multi_fail": multiple_failures,
}

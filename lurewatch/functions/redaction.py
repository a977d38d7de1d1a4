"""Redaction of secrets and addresses in report text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lurewatch.rules.fixed import SECRET_PATTERNS


def redact_secrets(text: Column) -> Column:
    """Replace secrets in the fixed order: later patterns see earlier labels."""
    # i: any case, U: Unicode classes, d: only \n ends a line
    flags = "(?iUd)"
    clean = text
    for label, pattern in SECRET_PATTERNS:
        clean = F.regexp_replace(clean, flags + pattern, f"[REDACTED {label}]")
    # most texts hold none: one search decides instead of eight
    anything = "|".join(f"(?:{pattern})" for _, pattern in SECRET_PATTERNS)
    return F.when(text.rlike(flags + anything), clean).otherwise(text)


def redact_address(address: Column) -> Column:
    """Star the local part but for its first and last character."""
    local = F.regexp_extract(address, r"(?s)\A(.*)@", 1)
    domain = F.substring_index(address, "@", -1)
    size = F.length(local)
    stars = F.when(size <= 2, F.repeat(F.lit("*"), size)).otherwise(
        F.concat(
            F.substring(local, 1, 1),
            F.repeat(F.lit("*"), F.greatest(size - 2, F.lit(0))),
            F.substring(local, -1, 1),
        )
    )
    return F.when(F.instr(address, "@") > 0, F.concat(stars, F.lit("@"), domain)).otherwise(address)

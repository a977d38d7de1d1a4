"""Attachment rules. Each takes one attachment and gives an array of findings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lurewatch.functions.arrays import list_map, present, string_map
from lurewatch.functions.text import fill, strip
from lurewatch.operators.finding import finding
from lurewatch.rules import RuleSet
from lurewatch.rules.fixed import MIME_EXTENSIONS
from lurewatch.rules.messages import MESSAGES

CATEGORY = "attachments"


def _location(att: Column) -> Column:
    return fill("Attachment: {}", att["filename"])


def severity_map(rules: RuleSet) -> Column:
    """Extension to severity as one constant map; unknown extensions give NULL."""
    return string_map(rules.extensions)


def double_extension(att: Column, rules: RuleSet) -> Column:
    extensions = att["detected_extensions"]
    description, advice = MESSAGES["double_extension"]
    quoted = F.concat(F.lit("['"), F.array_join(extensions, "', '"), F.lit("']"))
    return present(
        F.when(
            att["has_double_extension"],
            finding(
                CATEGORY,
                "critical",
                "Double file extension detected",
                fill("Filename: {}, Extensions: {}", att["filename"], quoted),
                _location(att),
                (fill(description, att["filename"], F.array_join(extensions, ", ")), advice),
            ),
        )
    )


def suspicious_type(att: Column, rules: RuleSet) -> Column:
    extension = F.lower(att["extension"])
    severity = severity_map(rules)[extension]
    description, advice = MESSAGES["suspicious_type"]
    return present(
        F.when(
            severity.isNotNull(),
            finding(
                CATEGORY,
                severity,
                fill("Suspicious file type: {}", extension),
                fill(
                    "Filename: {}, Extension: {}, MIME: {}",
                    att["filename"],
                    extension,
                    att["content_type"],
                ),
                _location(att),
                (fill(description, att["filename"], extension), advice),
            ),
        )
    )


def hidden_extension(att: Column, rules: RuleSet) -> Column:
    last, severities = F.lower(att["extension"]), severity_map(rules)
    description, advice = MESSAGES["hidden_extension"]
    risky = F.filter(
        att["detected_extensions"], lambda e: (e != last) & severities[e].isNotNull()
    )
    return F.transform(
        risky,
        lambda e: finding(
            CATEGORY,
            severities[e],
            fill("Hidden suspicious extension: {}", e),
            fill("Filename: {}, Hidden extension: {}", att["filename"], e),
            _location(att),
            (fill(description, att["filename"], e), advice),
        ),
    )


def mime_mismatch(att: Column, rules: RuleSet) -> Column:
    """Types outside the table are never a mismatch."""
    declared = strip(F.substring_index(F.lower(att["content_type"]), ";", 1))
    allowed = list_map(MIME_EXTENSIONS)[declared]
    description, advice = MESSAGES["mime_mismatch"]
    return present(
        F.when(
            (att["content_type"] != "")
            & (att["extension"] != "")
            & ~F.array_contains(allowed, F.lower(att["extension"])),
            finding(
                CATEGORY,
                "medium",
                "MIME type mismatch",
                fill("MIME: {}, Extension: {}", att["content_type"], att["extension"]),
                _location(att),
                (fill(description, att["content_type"], att["extension"]), advice),
                confidence=0.7,
            ),
        )
    )


ATTACHMENT_RULES = {
    "att_double_extension": double_extension,
    "att_suspicious_type": suspicious_type,
    "att_hidden_extension": hidden_extension,
    "att_mime_mismatch": mime_mismatch,
}

"""Rules on the sender's display name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lurewatch.functions.arrays import let
from lurewatch.functions.text import contains_first, fill
from lurewatch.operators.finding import finding
from lurewatch.rules.fixed import BRAND_NAME_COUNT, FREE_MAIL_DOMAINS, IMPERSONATION_NAMES
from lurewatch.rules.messages import MESSAGES

CATEGORY = "sender_identity"
# Fixed value: an address inside a display name.
ADDRESS_IN_NAME = r"(?U)[a-zA-Z]+@[a-zA-Z]+\.\w+"


def _shown() -> Column:
    return F.lower("from_display_name")


def display_impersonation() -> Column:
    """The first listed name shown to the reader but absent from the domain."""
    sender = F.col("from_domain")
    name = let(
        _shown(),
        lambda shown: contains_first(
            shown, IMPERSONATION_NAMES, also=lambda n: ~sender.contains(n)
        ),
    )
    description, advice = MESSAGES["display_name"]
    return F.when(
        (sender != "") & name.isNotNull(),
        finding(
            CATEGORY,
            "high",
            "Display name impersonation",
            fill("Display name: '{}', From: {}", F.col("from_display_name"), F.col("from_address")),
            "From header",
            (fill(description, name, sender), advice),
        ),
    )


def brand_on_free_mail() -> Column:
    sender = F.col("from_domain")
    brand = let(
        _shown(), lambda shown: contains_first(shown, IMPERSONATION_NAMES[:BRAND_NAME_COUNT])
    )
    description, advice = MESSAGES["brand_free_mail"]
    return F.when(
        sender.isin(FREE_MAIL_DOMAINS) & brand.isNotNull(),
        finding(
            CATEGORY,
            "high",
            "Brand name in display name with free email domain",
            fill("Display name: '{}', Domain: {}", F.col("from_display_name"), sender),
            "From header",
            (fill(description, sender), advice),
        ),
    )


def address_in_display() -> Column:
    return F.when(
        _shown().rlike(ADDRESS_IN_NAME),
        finding(
            CATEGORY,
            "medium",
            "Email address in display name",
            fill("Display name: '{}'", F.col("from_display_name")),
            "From header",
            MESSAGES["address_in_name"],
        ),
    )


SENDER_RULES = {
    "snd_display_impersonation": display_impersonation,
    "snd_brand_on_free_mail": brand_on_free_mail,
    "snd_address_in_display": address_in_display,
}

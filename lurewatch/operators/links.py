"""Link rules. Each takes one link (a struct column) and gives a finding or NULL.

A rule works on the element of an array as well as on an exploded column.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lurewatch.functions.arrays import let
from lurewatch.functions.text import contains_first, fill
from lurewatch.operators.finding import finding
from lurewatch.rules import RuleSet
from lurewatch.rules.fixed import FLAGGED_SHORTENERS, URL_KEYWORDS
from lurewatch.rules.messages import MESSAGES

CATEGORY = "links"
SHOWN_CHARACTERS = 100
DEEP_DOTS = 3


def _url(link: Column) -> Column:
    return fill("URL: {}", F.substring(link["href"], 1, SHOWN_CHARACTERS))


def _location(link: Column) -> Column:
    return fill("Link: {}", F.substring(link["href"], 1, SHOWN_CHARACTERS))


def domain_mismatch(link: Column, rules: RuleSet) -> Column:
    """A text that is nothing but a lower-case domain does not count as shown."""
    shown, target = link["display_domain"], link["target_domain"]
    return F.when(
        (shown != "")
        & (target != "")
        & (shown != target)
        & (shown != link["visible_text"])
        & shown.contains("."),
        finding(
            CATEGORY,
            "critical",
            "Link text domain differs from actual URL",
            fill("Visible: {}, Actual: {}", shown, target),
            _location(link),
            MESSAGES["link_mismatch"],
        ),
    )


def ip_host(link: Column, rules: RuleSet) -> Column:
    return F.when(
        link["is_ip_based"],
        finding(CATEGORY, "high", "IP-based URL", _url(link), _location(link), MESSAGES["link_ip"]),
    )


def shortened(link: Column, rules: RuleSet) -> Column:
    listed = list(dict.fromkeys([*FLAGGED_SHORTENERS, *rules.shorteners]))
    return F.when(
        F.lower(link["domain"]).isin(listed),
        finding(
            CATEGORY,
            "medium",
            "Shortened URL",
            fill("Shortener domain: {}", link["domain"]),
            _location(link),
            MESSAGES["link_short"],
        ),
    )


def plain_http(link: Column, rules: RuleSet) -> Column:
    return F.when(
        link["href"].startswith("http://"),
        finding(
            CATEGORY,
            "low",
            "Link uses HTTP instead of HTTPS",
            _url(link),
            _location(link),
            MESSAGES["link_http"],
        ),
    )


def punycode(link: Column, rules: RuleSet) -> Column:
    return F.when(
        link["is_punycode"],
        finding(
            CATEGORY,
            "high",
            "Punycode domain",
            fill("Domain: {}", link["domain"]),
            _location(link),
            MESSAGES["link_punycode"],
        ),
    )


def deep_subdomain(link: Column, rules: RuleSet) -> Column:
    dots = F.length(link["domain"]) - F.length(F.replace(link["domain"], F.lit("."), F.lit("")))
    description, advice = MESSAGES["link_subdomains"]
    return F.when(
        dots >= DEEP_DOTS,
        finding(
            CATEGORY,
            "medium",
            "Excessive subdomains",
            fill("Domain: {}", link["domain"]),
            _location(link),
            (fill(description, dots), advice),
            confidence=0.7,
        ),
    )


def url_keyword(link: Column, rules: RuleSet) -> Column:
    keyword = let(
        F.lower(F.concat(link["path"], link["query"])),
        lambda address: contains_first(address, URL_KEYWORDS),
    )
    description, advice = MESSAGES["link_keyword"]
    found = lambda word: F.when(
        word.isNotNull(),
        finding(
            CATEGORY,
            "low",
            fill("Suspicious keyword in URL: '{}'", word),
            _url(link),
            _location(link),
            (fill(description, word), advice),
            confidence=0.5,
            tags=("url-keyword",),
        ),
    )
    return let(keyword, found)


LINK_RULES = {
    "lnk_domain_mismatch": domain_mismatch,
    "lnk_ip_host": ip_host,
    "lnk_shortened": shortened,
    "lnk_http": plain_http,
    "lnk_punycode": punycode,
    "lnk_deep_subdomain": deep_subdomain,
    "lnk_keyword": url_keyword,
}

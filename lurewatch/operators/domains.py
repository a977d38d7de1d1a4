"""Look-alike domains.

A mail's domains are matched against the brands inside its own row. The brand
list is configuration held in the plan, so there is no join, no shuffle, and no
key on which a much-used domain could pile up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.functions.arrays import derive, sql_text, string_array
from lurewatch.functions.text import base_domain, fill, first_label
from lurewatch.operators.finding import finding
from lurewatch.rules import RuleSet
from lurewatch.rules.fixed import CHAR_SUBSTITUTES, DOMAIN_KEYWORDS, MAX_BRAND_DISTANCE
from lurewatch.rules.messages import MESSAGES

CATEGORY = "brand_impersonation"


def with_checked_domains(mail: DataFrame, rules: RuleSet) -> DataFrame:
    """Add `checked_domains`: sender, Reply-To, link targets; each once, in
    first-seen order, without the brands' own domains."""
    seen = F.concat(
        F.array("from_domain", "reply_domain"),
        F.transform("links", lambda l: F.lower(l["target_domain"])),
    )
    return mail.withColumn(
        "checked_domains", F.array_except(seen, string_array([*rules.exempt_domains, ""]))
    )


def domain_label(domain: Column) -> Column:
    """The label that brands are compared with."""
    return first_label(base_domain(domain))


def brand_array(rules: RuleSet) -> Column:
    """The brands as one constant array of structs, in rule order."""
    structs = ", ".join(
        f"named_struct('idx', {i}, 'domain', {sql_text(b.domain)}, "
        f"'name', {sql_text(b.name)}, 'label', {sql_text(b.label)})"
        for i, b in enumerate(rules.brands)
    )
    schema = "array<struct<idx:int,domain:string,name:string,label:string>>"
    return F.expr(f"CAST(array({structs}) AS {schema})")


def has_domain_keyword(label: Column) -> Column:
    return label.rlike("|".join(DOMAIN_KEYWORDS))


def has_char_substitution(label: Column, brand: Column) -> Column:
    """Same length, one or two differing places, each a listed look-alike.

    Stand-alone: such a pair is at edit distance 1 or 2 and so already counts as
    typosquatting; the rule chain never gets this far.
    """
    chars = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    pairs = F.filter(
        F.zip_with(chars(label), chars(brand), lambda a, b: F.when(a != b, F.concat(b, a))),
        lambda p: p.isNotNull(),
    )
    allowed = string_array([b + a for b, subs in CHAR_SUBSTITUTES.items() for a in subs])
    return (
        (F.length(label) == F.length(brand))
        & F.size(pairs).between(1, 2)
        & F.forall(pairs, lambda p: F.array_contains(allowed, p))
    )


def brand_hits(domains: Column, rules: RuleSet) -> Column:
    """For every domain its first matching brand: `struct<domain, label, hit>`,
    where `hit` is NULL or `struct<idx, name, brand_domain, brand_label, distance, rule>`."""
    domains = F.transform(
        domains, lambda d: F.struct(d.alias("domain"), domain_label(d).alias("label"))
    )
    domains = derive(domains, lambda d: {"has_keyword": has_domain_keyword(d["label"])})
    brands = brand_array(rules)

    def hits(d: Column) -> Column:
        near = F.transform(
            brands,
            lambda b: F.struct(
                b["idx"].alias("idx"),
                b["name"].alias("name"),
                b["domain"].alias("brand_domain"),
                b["label"].alias("brand_label"),
                # gives -1 beyond the bound
                F.levenshtein(d["label"], b["label"], MAX_BRAND_DISTANCE).alias("distance"),
            ),
        )
        matches = F.filter(
            near,
            lambda n: n["distance"].between(1, MAX_BRAND_DISTANCE)
            | (
                d["has_keyword"]
                & (d["label"] != n["brand_label"])
                & d["label"].contains(n["brand_label"])
            ),
        )
        return F.get(matches, F.lit(0))

    return derive(domains, lambda d: {"hit": hits(d)})


def is_typosquat(hit: Column) -> Column:
    return hit["distance"].between(1, MAX_BRAND_DISTANCE)


def typosquat(item: Column) -> Column:
    domain, hit = item["domain"], item["hit"]
    description, advice = MESSAGES["typosquat"]
    return F.when(
        is_typosquat(hit),
        finding(
            CATEGORY,
            "high",
            fill("Possible typosquatting of {}", hit["name"]),
            fill(
                "Domain: {}, Brand: {}, Distance: {}", domain, hit["brand_domain"], hit["distance"]
            ),
            fill("Domain: {}", domain),
            (
                fill(description, domain, hit["distance"], hit["name"], hit["brand_domain"]),
                fill(advice, hit["name"]),
            ),
            tags=("typosquatting",),
        ),
    )


def brand_keyword(item: Column) -> Column:
    domain, hit = item["domain"], item["hit"]
    description, advice = MESSAGES["brand_keyword"]
    return F.when(
        ~is_typosquat(hit),
        finding(
            CATEGORY,
            "medium",
            fill("Suspicious domain containing {} brand name", hit["name"]),
            fill("Domain: {}, Brand: {}", domain, hit["brand_domain"]),
            fill("Domain: {}", domain),
            (fill(description, domain, hit["brand_label"]), fill(advice, hit["name"])),
            confidence=0.7,
            tags=("brand-keyword",),
        ),
    )


DOMAIN_RULES = {"dom_typosquat": typosquat, "dom_brand_keyword": brand_keyword}

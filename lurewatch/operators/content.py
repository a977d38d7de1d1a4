"""Wording rules over subject and body.

Phrases share stems: pieces of text that several of them contain. A body is
searched for the stems first and for a phrase only if its stem is there, which
takes two fifths of the passes over a body that holds no lure.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.functions.arrays import sql_text, string_array, string_map
from lurewatch.functions.text import fill
from lurewatch.operators.finding import finding
from lurewatch.rules import RuleSet
from lurewatch.rules.fixed import EVIDENCE_PHRASES, MULTI_SIGNAL_MIN
from lurewatch.rules.messages import DEFAULT_SIGNAL_MESSAGE, MESSAGES, SIGNAL_MESSAGES

CATEGORY = "content"
LOCATION = "Email body/subject"


def with_searchable_text(mail: DataFrame) -> DataFrame:
    """Add `searchable`: subject and text body, the HTML text only without one."""
    body = F.when(F.col("text_body") != "", F.col("text_body")).otherwise(F.col("html_text"))
    text = F.concat_ws(
        "\n", F.nullif(F.col("subject"), F.lit("")), F.nullif(body, F.lit(""))
    )
    return mail.withColumn("searchable", F.lower(text))


def stems(phrases: list[str], shortest: int = 5) -> list[tuple[str, list[str]]]:
    """Phrases grouped by a piece all of a group contain; most shared, then longest, first."""
    groups, left = [], list(phrases)
    while left:
        shared = Counter(
            piece
            for p in left
            for piece in {p[i:j] for i in range(len(p)) for j in range(i + shortest, len(p) + 1)}
        )
        stem, times = max(
            shared.items(), key=lambda s: (s[1], len(s[0]), s[0]), default=(left[0], 1)
        )
        if times == 1:
            return groups + [(p, [p]) for p in left]
        groups.append((stem, [p for p in left if stem in p]))
        left = [p for p in left if stem not in p]
    return groups


def found_phrases(text: Column, rules: RuleSet) -> Column:
    """All phrases of all groups that occur in `text`, lower case, in no set order."""
    wanted = list(dict.fromkeys(p.lower() for g in rules.signals for p in g.phrases))
    if not wanted:
        return string_array([])
    structs = ", ".join(
        f"named_struct('stem', {sql_text(stem)}, 'phrases', array({', '.join(map(sql_text, group))}))"
        for stem, group in stems(wanted)
    )
    table = F.expr(f"array({structs})")
    likely = F.filter(table, lambda s: text.contains(s["stem"]))
    return F.flatten(
        F.transform(likely, lambda s: F.filter(s["phrases"], lambda p: text.contains(p)))
    )


def with_signals(mail: DataFrame, rules: RuleSet) -> DataFrame:
    """Add `signals`: per group that occurs, its key, severity and phrases in rule order."""
    mail = with_searchable_text(mail)
    # `searchable` is read more than once, so it stays a column of its own
    mail = mail.withColumn("_found", found_phrases(F.col("searchable"), rules))
    groups = []
    for g in rules.signals:
        matched = F.array_intersect(string_array([p.lower() for p in g.phrases]), "_found")
        shown = {p.lower(): p for p in g.phrases if p != p.lower()}
        if shown:
            # reported as written in the rules
            written = string_map(shown)
            matched = F.transform(matched, lambda p: F.coalesce(written[p], p))
        groups.append(
            F.struct(
                F.lit(g.key).alias("key"),
                F.lit(g.severity).alias("severity"),
                matched.alias("phrases"),
            )
        )
    schema = "array<struct<key:string,severity:string,phrases:array<string>>>"
    signals = F.filter(F.array(*groups).cast(schema), lambda s: F.size(s["phrases"]) > 0)
    return mail.withColumn(
        "signals", F.when(F.size("_found") > 0, signals).otherwise(F.array().cast(schema))
    ).drop("_found")


def signal_finding(signal: Column) -> Column:
    text = lambda i, default: F.coalesce(
        string_map({key: message[i] for key, message in SIGNAL_MESSAGES.items()})[signal["key"]],
        F.lit(default),
    )
    found = finding(
        CATEGORY,
        signal["severity"],
        fill("Phishing signal: {}", F.replace(signal["key"], F.lit("_"), F.lit(" "))),
        fill(
            "Matched patterns: {}",
            F.array_join(F.slice(signal["phrases"], 1, EVIDENCE_PHRASES), ", "),
        ),
        LOCATION,
        (text(0, DEFAULT_SIGNAL_MESSAGE[0]), text(1, DEFAULT_SIGNAL_MESSAGE[1])),
    )
    return found.withField("tags", F.array(signal["key"]))


def multi_signal() -> Column:
    keys = F.array_join(F.array_sort(F.transform("signals", lambda s: s["key"])), ", ")
    description, advice = MESSAGES["multi_signal"]
    return F.when(
        F.size("signals") >= MULTI_SIGNAL_MIN,
        finding(
            CATEGORY,
            "high",
            "Multiple phishing signals detected",
            fill("Categories: {}", keys),
            LOCATION,
            (fill(description, F.size("signals"), keys), advice),
            tags=("multi-signal",),
        ),
    )

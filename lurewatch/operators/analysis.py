"""Analyzers, findings and scores. All of it is computed inside the mail's row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lurewatch.functions.arrays import present
from lurewatch.operators import attachments, authentication, content, domains, headers, links, sender
from lurewatch.operators.mailfacts import with_sender_domains
from lurewatch.rules import RuleSet
from lurewatch.rules.fixed import (
    LEVEL_ABOVE,
    LEVEL_UPPER_BOUNDS,
    MAX_SCORE,
    SEVERITY_POINTS,
)
from lurewatch.schema import FINDING

TOP_CONTRIBUTORS = 5


@dataclass(frozen=True)
class Analyzer:
    """Adds to the mail an array of findings named by `column`.

    Write your own by giving a function from (mail, rules) to a mail with that
    column; the mail has the normalized fields and the three sender domains.
    """

    name: str
    apply: Callable[[DataFrame, RuleSet], DataFrame]

    @property
    def column(self) -> str:
        return f"findings_{self.name}"


def _headers(mail: DataFrame, rules: RuleSet) -> DataFrame:
    return mail.withColumn(
        "findings_headers", present(*[r() for r in headers.HEADER_RULES.values()])
    )


def _sender(mail: DataFrame, rules: RuleSet) -> DataFrame:
    return mail.withColumn(
        "findings_sender", present(*[r() for r in sender.SENDER_RULES.values()])
    )


def _authentication(mail: DataFrame, rules: RuleSet) -> DataFrame:
    mail = authentication.with_auth_results(mail)
    return mail.withColumn(
        "findings_authentication",
        present(*[r() for r in authentication.AUTH_RULES.values()]),
    )


def _links(mail: DataFrame, rules: RuleSet) -> DataFrame:
    per_link = lambda l: present(*[r(l, rules) for r in links.LINK_RULES.values()])
    return mail.withColumn("findings_links", F.flatten(F.transform("links", per_link)))


def _domains(mail: DataFrame, rules: RuleSet) -> DataFrame:
    mail = domains.with_checked_domains(mail, rules)
    hits = F.filter(
        domains.brand_hits(F.col("checked_domains"), rules), lambda d: d["hit"].isNotNull()
    )
    rule = lambda d: F.coalesce(*[r(d) for r in domains.DOMAIN_RULES.values()])
    return mail.withColumn("findings_domains", F.transform(hits, rule))


def _attachments(mail: DataFrame, rules: RuleSet) -> DataFrame:
    per_file = lambda a: F.concat(
        *[r(a, rules) for r in attachments.ATTACHMENT_RULES.values()]
    )
    return mail.withColumn(
        "findings_attachments", F.flatten(F.transform("attachments", per_file))
    )


def _content(mail: DataFrame, rules: RuleSet) -> DataFrame:
    mail = content.with_signals(mail, rules)
    return mail.withColumn(
        "findings_content",
        F.concat(
            F.transform("signals", content.signal_finding), present(content.multi_signal())
        ),
    )


DEFAULT_ANALYZERS = (
    Analyzer("headers", _headers),
    Analyzer("sender", _sender),
    Analyzer("authentication", _authentication),
    Analyzer("links", _links),
    Analyzer("domains", _domains),
    Analyzer("attachments", _attachments),
    Analyzer("content", _content),
)


#: A user's own analyzer: findings of each mail of a batch, as dicts with some of the fields of FINDING.
BatchFunction = Callable[[pa.RecordBatch], list[list[dict]]]
FINDING_TYPE = pa.list_(
    pa.struct([
        *[(n, pa.string()) for n in ("title", "category", "severity", "description", "evidence", "recommendation", "location")],
        ("confidence", pa.float64()), ("tags", pa.list_(pa.string())),
    ])
)


def batch_analyzer(fields: Sequence[str], *functions: BatchFunction, name: str = "python") -> Analyzer:
    """Analyzers written as Python functions over Arrow batches of mails, as one of the chain.

    The functions see the columns `fields`; all of them share one crossing into
    Python, and nothing is shuffled. Their findings come in the order of the functions.
    What a finding leaves out is empty, its confidence 1; a `title` and a
    `severity` that exists are needed, or the job fails.
    """

    def checked(found: dict) -> dict:
        unknown = set(found) - {f.name for f in FINDING_TYPE.value_type}
        if unknown or not found.get("title"):
            raise ValueError(f"not a finding: {found!r}")
        if found.get("severity") not in SEVERITY_POINTS:
            raise ValueError(f"unknown severity: {found.get('severity')!r}")
        empty = {f.name: "" for f in FINDING_TYPE.value_type} | {"confidence": 1.0, "tags": [], "category": name}
        return empty | found

    def apply(mail: DataFrame, rules: RuleSet) -> DataFrame:
        seen = [mail.columns.index(f) for f in fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shown = pa.RecordBatch.from_arrays([batch.column(i) for i in seen], names=list(fields))
                results = [f(shown) for f in functions]
                if any(len(r) != batch.num_rows for r in results):
                    raise ValueError("one list of findings per mail is needed")
                rows = [[checked(x) for found in per_mail for x in found] for per_mail in zip(*results)] if results else [[]] * batch.num_rows
                arrays = [*batch.columns, pa.array(rows, FINDING_TYPE)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, f"findings_{name}"])

        added = T.StructType.fromDDL(f"findings_{name} array<{FINDING}>")
        return mail.mapInArrow(run, T.StructType([*mail.schema.fields, *added.fields]))

    return Analyzer(name, apply)


def run_analysis(
    mail: DataFrame,
    rules: RuleSet | None = None,
    analyzers: Sequence[Analyzer] = DEFAULT_ANALYZERS,
) -> DataFrame:
    """Add `findings`: those of all analyzers, in analyzer order, then in the
    order the analyzer gave them. The position in the array is the ordinal."""
    rules = RuleSet.builtin() if rules is None else rules
    kept = [c for c in mail.columns]
    mail = with_sender_domains(mail)
    for analyzer in analyzers:
        mail = analyzer.apply(mail, rules)
    arrays = [F.col(a.column).cast(f"array<{FINDING}>") for a in analyzers]
    if not arrays:
        arrays = [F.array().cast(f"array<{FINDING}>")]
    return mail.select(*kept, F.concat(*arrays).alias("findings"))


def severity_points(severity: Column) -> Column:
    """Points of a severity; one that does not exist, or NULL, fails the job."""
    unknown = F.concat(F.lit("unknown severity: "), F.coalesce(severity, F.lit("NULL")))
    return F.coalesce(
        *[F.when(severity == name, F.lit(points)) for name, points in SEVERITY_POINTS.items()],
        F.raise_error(unknown).cast("int"),
    )


def risk_score(findings: Column) -> Column:
    total = F.aggregate(
        findings, F.lit(0), lambda total, f: total + severity_points(f["severity"])
    )
    return F.least(F.lit(MAX_SCORE), total).cast("double")


def risk_level(score: Column) -> Column:
    return F.coalesce(
        *[F.when(score <= bound, F.lit(level)) for bound, level in LEVEL_UPPER_BOUNDS],
        F.lit(LEVEL_ABOVE),
    )


def category_scores(findings: Column) -> Column:
    """Uncapped points and count per category that occurs, by category name."""

    def one(category: Column) -> Column:
        of_category = F.filter(findings, lambda f: f["category"] == category)
        return F.struct(
            category.alias("category"),
            F.aggregate(
                of_category, F.lit(0), lambda total, f: total + severity_points(f["severity"])
            )
            .cast("double")
            .alias("score"),
            F.size(of_category).alias("finding_count"),
        )

    names = F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["category"])))
    return F.transform(names, one)


def top_contributors(findings: Column, limit: int = TOP_CONTRIBUTORS) -> Column:
    """Titles of the weightiest findings; equal ones keep their order."""
    of_severity = lambda severity: F.filter(findings, lambda f: f["severity"] == severity)
    by_weight = sorted(SEVERITY_POINTS, key=SEVERITY_POINTS.get, reverse=True)
    ranked = F.concat(*map(of_severity, by_weight))
    return F.transform(F.slice(ranked, 1, limit), lambda f: f["title"])


def with_finding_ids(findings: Column, email_id: Column) -> Column:
    """Give each finding an id that reruns reproduce, and its 1-based ordinal."""
    return F.transform(
        findings,
        lambda f, i: F.struct(
            F.substring(
                F.sha2(
                    F.concat_ws("|", email_id.cast("string"), (i + 1).cast("string"), f["title"]),
                    256,
                ),
                1,
                12,
            ).alias("id"),
            (i + 1).alias("ordinal"),
            *[f[n].alias(n) for n in (
                "title", "category", "severity", "description", "evidence",
                "recommendation", "location", "confidence", "tags",
            )],
        ),
    )


def score_mail(analyzed: DataFrame) -> DataFrame:
    """Add the analysis result to mails that carry `findings`."""
    findings = F.col("findings")
    return (
        analyzed.withColumn("findings", with_finding_ids(findings, F.col("email_id")))
        .withColumn("risk_score", risk_score(findings))
        .withColumns(
            {
                "risk_level": risk_level(F.col("risk_score")),
                "category_scores": category_scores(findings),
                "top_contributors": top_contributors(findings),
                "finding_count": F.size(findings),
            }
        )
    )

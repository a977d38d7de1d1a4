"""Reports as text columns, one per analyzed mail.

Secrets are redacted field by field before a report is put together, so a
pattern that runs to the end of a word cannot eat markup. No report holds the
body of the mail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.functions.redaction import redact_secrets
from lurewatch.functions.text import fill

FOOTER = "Generated by lurewatch"
STYLE = (
    "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}"
    "td,th{border:1px solid #999;padding:4px}.score{font-size:2em}"
)
# Verdict, summary and advice for the reader, by level.
VERDICTS = {
    "critical": ("YES", "This mail shows strong signs of phishing."),
    "high": ("LIKELY", "This mail shows several signs of phishing."),
    "medium": ("POSSIBLY", "This mail shows some signs of phishing."),
    "low": ("PROBABLY NOT", "This mail shows few or no signs of phishing."),
}
WARNING_ADVICE = [
    "Do NOT click links or open files in this mail.",
    "Do NOT answer it or give any password.",
    "Report it to the people who look after security.",
    "Contact the sender by a channel you already know.",
]
CALM_ADVICE = [
    "Do NOT give passwords by mail, whoever asks.",
    "Look at links before you follow them.",
]


def with_report_fields(analyzed: DataFrame) -> DataFrame:
    """Redacted copies of what reports show: `r_subject`, `r_findings`, `r_links`, `r_files`."""
    return analyzed.select(
        "email_id",
        "message_id",
        "from_address",
        "from_display_name",
        "date_raw",
        "risk_score",
        "risk_level",
        "category_scores",
        "top_contributors",
        redact_secrets(F.col("subject")).alias("r_subject"),
        F.transform(
            "findings",
            lambda f: f.withField("evidence", redact_secrets(f["evidence"])).withField(
                "location", redact_secrets(f["location"])
            ),
        ).alias("r_findings"),
        F.transform(
            "links",
            lambda l: F.struct(
                redact_secrets(l["visible_text"]).alias("visible_text"),
                redact_secrets(l["href"]).alias("href"),
                l["domain"].alias("domain"),
                l["is_ip_based"].alias("is_ip_based"),
                l["is_shortened"].alias("is_shortened"),
                l["is_punycode"].alias("is_punycode"),
                l["uses_https"].alias("uses_https"),
            ),
        ).alias("r_links"),
        F.transform(
            "attachments",
            lambda a: F.struct(
                a["filename"].alias("filename"),
                a["content_type"].alias("content_type"),
                a["size_bytes"].alias("size_bytes"),
                a["sha256"].alias("sha256"),
                a["has_double_extension"].alias("has_double_extension"),
                a["is_suspicious_type"].alias("is_suspicious_type"),
            ),
        ).alias("r_files"),
    )


def _score() -> Column:
    return F.col("risk_score").cast("int")


def _lines(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "\n")


def json_report() -> Column:
    return F.to_json(
        F.struct(
            F.col("risk_score"),
            F.col("risk_level"),
            F.struct(
                F.col("message_id"),
                F.col("r_subject").alias("subject"),
                F.col("from_address"),
                F.col("from_display_name"),
                F.col("date_raw"),
            ).alias("email_summary"),
            F.transform(
                "r_findings",
                lambda f: F.struct(
                    *[
                        f[n].alias(n)
                        for n in (
                            "title", "category", "severity", "description", "evidence",
                            "recommendation", "location", "confidence", "tags",
                        )
                    ]
                ),
            ).alias("findings"),
            F.col("category_scores"),
            F.col("top_contributors"),
            F.struct(
                F.col("r_links").alias("links"), F.col("r_files").alias("attachments")
            ).alias("indicators"),
        )
    )


def markdown_report() -> Column:
    cell = lambda text: F.replace(text, F.lit("|"), F.lit("\\|"))
    return F.concat_ws(
        "\n",
        F.lit("# Mail threat report"),
        F.lit(""),
        fill("**Risk score:** {}/100 ({})", _score(), F.upper("risk_level")),
        fill("**Subject:** {}", F.col("r_subject")),
        fill("**From:** {} <{}>", F.col("from_display_name"), F.col("from_address")),
        fill("**Date:** {}", F.col("date_raw")),
        F.lit(""),
        fill("## Findings ({})", F.size("r_findings")),
        F.lit(""),
        _lines(
            F.col("r_findings"),
            lambda f: fill(
                "{}. **{}** [{}] {} ({})",
                f["ordinal"], f["title"], F.upper(f["severity"]), f["evidence"], f["recommendation"],
            ),
        ),
        F.lit(""),
        F.lit("## Links"),
        F.lit(""),
        F.lit("| Text | Address | Domain |"),
        F.lit("| --- | --- | --- |"),
        _lines(
            F.col("r_links"),
            lambda l: fill("| {} | {} | {} |", cell(l["visible_text"]), cell(l["href"]), l["domain"]),
        ),
        F.lit(""),
        F.lit("## Attachments"),
        F.lit(""),
        F.lit("| Name | Type | Bytes | SHA-256 |"),
        F.lit("| --- | --- | --- | --- |"),
        _lines(
            F.col("r_files"),
            lambda a: fill(
                "| {} | {} | {} | {} |",
                cell(a["filename"]), a["content_type"], a["size_bytes"], a["sha256"],
            ),
        ),
        F.lit(""),
        F.lit(f"*{FOOTER}*"),
    )


def _escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def html_report() -> Column:
    return F.concat_ws(
        "\n",
        F.lit("<!DOCTYPE html>"),
        F.lit('<html lang="en">'),
        F.lit(f'<head><meta charset="utf-8"><title>Mail threat report</title><style>{STYLE}</style></head>'),
        F.lit("<body>"),
        F.lit("<h1>Mail threat report</h1>"),
        fill('<p class="score">{}/100 {}</p>', _score(), F.upper("risk_level")),
        fill("<p>Subject: {}</p>", _escape(F.col("r_subject"))),
        fill("<p>From: {}</p>", _escape(F.col("from_address"))),
        F.lit("<table><tr><th>Severity</th><th>Finding</th><th>Evidence</th></tr>"),
        _lines(
            F.col("r_findings"),
            lambda f: fill(
                "<tr><td>{}</td><td>{}</td><td>{}</td></tr>",
                F.upper(f["severity"]), _escape(f["title"]), _escape(f["evidence"]),
            ),
        ),
        F.lit("</table>"),
        F.lit("<ul>"),
        _lines(F.col("r_links"), lambda l: fill("<li>{}</li>", _escape(l["href"]))),
        _lines(F.col("r_files"), lambda a: fill("<li>{}</li>", _escape(a["filename"]))),
        F.lit("</ul>"),
        F.lit(f"<footer>{FOOTER}</footer>"),
        F.lit("</body>"),
        F.lit("</html>"),
    )


def user_report() -> Column:
    """A report for readers without background; the verdict follows the level."""
    level = F.col("risk_level")
    by_level = lambda i: F.coalesce(
        *[F.when(level == name, F.lit(verdict[i])) for name, verdict in VERDICTS.items()]
    )
    listed = lambda items: F.lit("\n".join(f"- {x}" for x in items))
    return F.concat_ws(
        "\n",
        F.lit("# Is this mail phishing?"),
        F.lit(""),
        fill("**{}** ({}/100)", by_level(0), _score()),
        fill("Subject: {}", F.col("r_subject")),
        F.lit(""),
        F.lit("## Simple Explanation"),
        F.lit(""),
        by_level(1),
        _lines(F.col("top_contributors"), lambda t: fill("- {}", t)),
        F.lit(""),
        F.lit("## What You Should Do"),
        F.lit(""),
        F.when(level == "low", listed(CALM_ADVICE)).otherwise(listed(WARNING_ADVICE)),
        F.lit(""),
        F.lit(FOOTER),
    )


REPORTS = {
    "report_json": json_report,
    "report_markdown": markdown_report,
    "report_html": html_report,
    "report_user": user_report,
}


def report(analyzed: DataFrame, kind: str) -> DataFrame:
    """`(email_id, report)`; write it with `write.text` or beside the analysis."""
    return with_report_fields(analyzed).select("email_id", REPORTS[kind]().alias("report"))

from __future__ import annotations

import os
import sys
import tempfile
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from lurewatch.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ["TZ"] = "UTC"
    scratch = tempfile.mkdtemp(prefix="lurewatch-tests-")
    session = local_session(4, **{"spark.sql.warehouse.dir": scratch})
    yield session
    session.stop()


MAIL_DDL = (
    "email_id string, message_id string, subject string, from_address string, "
    "from_display_name string, reply_to string, return_path string, date timestamp, "
    "date_raw string, authentication_results string, text_body string, html_body string, "
    "html_text string, anchors array<struct<visible_text:string,href:string>>, "
    "files array<struct<filename:string,content_type:string,size_bytes:bigint,sha256:string>>, "
    "parse_error string"
)


@pytest.fixture(scope="session")
def make_mail(spark):
    """Parsed mails from keyword dicts; what is left out does not fire any rule."""

    def make(*mails: dict):
        rows = []
        for i, m in enumerate(mails):
            row = dict(
                email_id=str(i), message_id="<m@example.com>", subject="", from_address="a@example.com",
                from_display_name="", reply_to="", return_path="", date=datetime(2024, 1, 1),
                date_raw="x", authentication_results="mx; spf=pass; dkim=pass; dmarc=pass",
                text_body="", html_body="", html_text="", anchors=[], files=[], parse_error=None,
            )
            row.update(m)
            rows.append(tuple(row[f.split(" ")[0]] for f in _names()))
        return spark.createDataFrame(rows, MAIL_DDL)

    def _names():
        return [
            "email_id", "message_id", "subject", "from_address", "from_display_name", "reply_to",
            "return_path", "date", "date_raw", "authentication_results", "text_body", "html_body",
            "html_text", "anchors", "files", "parse_error",
        ]

    return make


@pytest.fixture(scope="session")
def titles(make_mail):
    """Finding titles per mail, for one chosen analyzer or all."""
    from lurewatch.operators.analysis import DEFAULT_ANALYZERS, run_analysis
    from lurewatch.operators.mailfacts import normalize_mail

    def run(*mails: dict, only: str | None = None):
        chosen = [a for a in DEFAULT_ANALYZERS if only in (None, a.name)]
        found = run_analysis(normalize_mail(make_mail(*mails)), analyzers=chosen)
        rows = found.selectExpr(
            "int(email_id) AS i", "transform(findings, f -> f.title) AS titles"
        ).orderBy("i").collect()
        return [r.titles for r in rows]

    return run

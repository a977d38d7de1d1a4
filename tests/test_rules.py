"""Each rule on mails made for it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lurewatch.functions.arrays import string_array
from lurewatch.operators import content, domains
from lurewatch.operators.analysis import DEFAULT_ANALYZERS, Analyzer, risk_level, run_analysis
from lurewatch.operators.finding import finding
from lurewatch.operators.mailfacts import normalize_mail
from lurewatch.rules import Brand, RuleSet, SignalGroup, rule_table


def anchor(href, text="go"):
    return [(text, href)]


def test_headers(titles):
    got = titles(
        {"reply_to": "x@other.example"},
        {"return_path": "x@other.example"},
        {"message_id": ""},
        {"message_id": "<1@other.example>"},
        {"message_id": "<1@sub.example.com>"},
        {"message_id": "no domain"},
        {"date": None, "date_raw": "soon"},
        {"from_address": "", "reply_to": "x@y.z", "return_path": "x@y.z", "message_id": "<1@z>"},
        {"reply_to": "b@example.com", "return_path": "c@example.com"},
        only="headers",
    )
    assert got == [
        ["Reply-To domain mismatch"], ["Return-Path domain mismatch"], ["Missing Message-ID"],
        ["Message-ID domain mismatch"], [], [], ["Missing or invalid Date header"], [], [],
    ]


def test_sender(titles):
    fake, free, shown = (
        "Display name impersonation", "Brand name in display name with free email domain",
        "Email address in display name",
    )
    got = titles(
        {"from_display_name": "PayPal Support"},
        {"from_display_name": "PayPal", "from_address": "x@paypal.com"},
        {"from_display_name": "Allegro", "from_address": "x@wp.pl"},
        {"from_display_name": "InPost", "from_address": "x@wp.pl"},
        {"from_display_name": "boss@corp.example"},
        {"from_display_name": "boss@corp.example", "from_address": ""},
        {"from_display_name": "ądam@cx.żx", "from_address": "a@b.example"},
        only="sender",
    )
    assert got == [[fake], [], [fake, free], [fake], [shown], [shown], [shown]]


def test_authentication(titles):
    results = [
        "", "mx; spf=pass", "SPF = Fail; dkim=fail", "spf=softfail; dkim=none", "spf=none; dmarc=none",
        "spf=fail; dmarc=fail", "spf=żfail", "x-spf=fail spf=pass", "spf=neutral",
    ]
    got = titles(*[{"authentication_results": r} for r in results], only="authentication")
    assert got == [
        ["Missing Authentication-Results"], [], ["SPF check failed", "DKIM verification failed"],
        ["SPF soft fail", "No DKIM signature"], ["No SPF record", "No DMARC policy"],
        ["SPF check failed", "DMARC check failed", "Multiple authentication failures"], [],
        ["SPF check failed"], [],
    ]


def test_links(titles):
    got = titles(
        {"anchors": anchor("https://evil.example/", "https://paypal.com/x")},
        {"anchors": anchor("https://evil.example/", "paypal.com")},
        {"anchors": anchor("https://evil.example/", "PayPal.com")},
        {"anchors": anchor("https://10.1.2.3/")},
        {"anchors": anchor("https://t.ly/x")},
        {"anchors": anchor("http://plain.example/")},
        {"anchors": anchor("HTTP://plain.example/")},
        {"anchors": anchor("https://xn--pple-43d.com/")},
        {"anchors": anchor("https://a.b.c.d.example/")},
        {"anchors": anchor("https://x.example/verify/login")},
        {"anchors": anchor("https://x.example/lo?gin")},
        {"anchors": anchor("mailto:a@b.c") + anchor("#x") + anchor(" ")},
        {"anchors": anchor("https://t.ly/x") * 3, "text_body": "https://t.ly/x."},
        only="links",
    )
    mismatch = "Link text domain differs from actual URL"
    assert got == [
        [mismatch], [], [mismatch], ["IP-based URL", "Excessive subdomains"], ["Shortened URL"],
        ["Link uses HTTP instead of HTTPS"], [], ["Punycode domain"], ["Excessive subdomains"],
        ["Suspicious keyword in URL: 'login'"], ["Suspicious keyword in URL: 'login'"], [],
        ["Shortened URL"],
    ]


@pytest.mark.parametrize(
    "domain, title",
    [
        ("micros0ft.com", "Possible typosquatting of Microsoft"),
        ("paypa1.com", "Possible typosquatting of PayPal"),
        ("go0gle.com", "Possible typosquatting of Google"),
        ("a1legro.pl", "Possible typosquatting of Allegro"),
        ("microsoft-login-verify.com", "Suspicious domain containing Microsoft brand name"),
        ("microsoft.com", None), ("outlook.com", None), ("amazon.co.uk", None),
        ("www.amazon.co.uk", "Possible typosquatting of PKO BP"), ("x.org.uk", "Possible typosquatting of ING Bank"),
        ("aol.com", "Possible typosquatting of OLX"), ("wp.pl", "Possible typosquatting of UPS"),
        ("o2.pl", "Possible typosquatting of OLX"), ("ow.ly", "Possible typosquatting of OLX"),
        ("is.gd", "Possible typosquatting of ING Bank"), ("goo.gl", "Possible typosquatting of PKO BP"),
        ("s.id", "Possible typosquatting of UPS"), ("dpd.com", "Possible typosquatting of DHL"),
        ("t.co", None), ("bit.ly", None), ("rb.gy", None), ("example.com", None),
    ],
)
def test_brands(look_alikes, domain, title):
    assert look_alikes[domain] == ([title] if title else [])


@pytest.fixture(scope="module")
def look_alikes(titles):
    names = [p[0] for p in test_brands.pytestmark[0].args[1]]
    return dict(zip(names, titles(*[{"from_address": f"a@{n}"} for n in names], only="domains")))


def test_domains_come_once_in_first_seen_order(make_mail):
    from lurewatch.operators.mailfacts import with_sender_domains

    mail = with_sender_domains(normalize_mail(make_mail({
        "from_address": "a@one.example", "reply_to": "b@TWO.example",
        "anchors": anchor("https://three.example/") + anchor("https://ONE.example/")
        + anchor("https://github.com/") + anchor("relative"),
    })))
    row = domains.with_checked_domains(mail, RuleSet.builtin()).first()
    assert row.checked_domains == ["one.example", "two.example", "three.example"]


def test_char_substitution_alone(spark):
    pairs = [("micros0ft", "microsoft", True), ("m1cros0ft", "microsoft", True), ("xicrosoft", "microsoft", False),
             ("microsoft", "microsoft", False), ("m1cr0s0ft", "microsoft", False), ("goog1", "google", False)]
    df = spark.createDataFrame(pairs, "label string, brand string, want boolean")
    got = df.select("want", domains.has_char_substitution(F.col("label"), F.col("brand")).alias("is"))
    assert all(r.want == r["is"] for r in got.collect())


def test_attachments(titles):
    def mail(name, kind=""):
        return {"files": [(name, kind, 1, "")]}

    got = titles(
        mail("report.pdf", "application/pdf"), mail("a.pdf.exe"), mail("run.JS"), mail("a.js.vbs.txt"),
        mail("disk.iso"), mail("a.txt", "application/pdf"), mail("a.txt", "APPLICATION/PDF; x=y"),
        mail("a.exe.exe"), mail("README", "application/pdf"), mail("a.csv", "text/plain"),
        mail("x.bin", "application/octet-stream"), mail("archive.tar.gz"), mail(".lnk"),
        only="attachments",
    )
    double = "Double file extension detected"
    assert got == [
        [], [double, "Suspicious file type: .exe"], ["Suspicious file type: .js"],
        [double, "Hidden suspicious extension: .js", "Hidden suspicious extension: .vbs"],
        ["Suspicious file type: .iso"], ["MIME type mismatch"], ["MIME type mismatch"],
        [double, "Suspicious file type: .exe"], [], [], [], [double], ["Suspicious file type: .lnk"],
    ]


def test_content(titles, make_mail):
    got = titles(
        {"text_body": "ACT NOW"}, {"subject": "Urgently"}, {"text_body": "twoje KONTO ZOSTAŁO zablokowane"},
        {"text_body": "our it department"}, {"html_body": "<p>", "html_text": "verify your account"},
        {"html_body": "<p>", "html_text": "verify your account", "text_body": "hello"},
        {"text_body": "act now, click here, gift card"}, {"text_body": "verify your\nidentity"},
        only="content",
    )
    signal = lambda *names: [f"Phishing signal: {n}" for n in names]
    assert got == [
        signal("urgency"), signal("urgency"), signal("account suspension"), signal("impersonation language"),
        signal("credential request"), [],
        signal("urgency", "gift card", "link click request") + ["Multiple phishing signals detected"], [],
    ]
    mail = normalize_mail(make_mail({"text_body": "act now act immediately immediate action urgent urgently last chance IT SUPPORT"}))
    shown = [f.evidence for f in run_analysis(mail).first().findings]
    assert shown == [
        "Matched patterns: act now, act immediately, immediate action, urgent, urgently",
        "Matched patterns: IT support",
    ]


def test_stems_find_what_a_plain_search_finds(spark):
    from conftest import SMALL
    from lurewatch.sources import derived

    rules = RuleSet.builtin()
    every = [p.lower() for g in rules.signals for p in g.phrases]
    mail = content.with_searchable_text(derived.mail_without_anchors(spark, SMALL))
    texts = [r.searchable for r in mail.select("searchable").collect()]
    texts += [" ".join(every), *every, "account konto gift your"]
    df = spark.createDataFrame([(t,) for t in texts], "searchable string")
    for r in df.select("searchable", content.found_phrases(F.col("searchable"), rules).alias("f")).collect():
        assert sorted(r.f) == sorted(p for p in every if p in r.searchable)


def test_levels(spark):
    edges = {0: "low", 30: "low", 31: "medium", 60: "medium", 61: "high", 80: "high", 81: "critical", 100: "critical"}
    df = spark.createDataFrame([(float(s),) for s in edges], "s double")
    assert {r.s: r.l for r in df.select("s", risk_level(F.col("s")).alias("l")).collect()} == edges


def test_own_analyzer_and_subset(make_mail):
    def apply(mail, rules):
        found = F.when(
            F.col("subject").contains("!"), finding("content", "info", "Shouting", "x", "Subject", ("d", "r"))
        )
        return mail.withColumn("findings_shouting", F.array_compact(F.array(found)))

    mail = normalize_mail(make_mail({"subject": "Hey!", "message_id": ""}))
    chosen = [Analyzer("shouting", apply), DEFAULT_ANALYZERS[0]]
    assert [f.title for f in run_analysis(mail, analyzers=chosen).first().findings] == ["Shouting", "Missing Message-ID"]
    assert run_analysis(mail, analyzers=[]).first().findings == []


def test_rule_files(tmp_path, spark, make_mail):
    (tmp_path / "brands.yml").write_text("brands:\n  - domain: acme.example\n    name: Acme\n    aliases: [acme.test]\n")
    (tmp_path / "content_patterns.yml").write_text('odd:\n  patterns: ["it\'s \\\\ odd"]\n')
    rules = RuleSet.from_directory(tmp_path)
    assert rules.brands == (Brand("acme.example", "Acme", ("acme.test",)),)
    assert rules.signals == (SignalGroup("odd", "medium", ("it's \\ odd",)),)
    assert rules.shorteners == () and rules.extensions == {}
    assert rule_table(spark, rules).count() == 4
    mail = normalize_mail(make_mail({
        "from_address": "a@acmo.example", "text_body": "IT'S \\ ODD", "files": [("a.exe", "", 1, "")]}))
    got = [(f.title, f.severity) for f in run_analysis(mail, rules).first().findings]
    assert got[-1] == ("Phishing signal: odd", "medium") and ("Possible typosquatting of Acme", "high") in got
    assert "Suspicious file type: .exe" not in dict(got)


def test_string_literals(spark):
    odd = ["it's", "back\\slash", 'quo"te', "new\nline", "ż"]
    assert spark.range(1).select(string_array(odd).alias("a")).first().a == odd

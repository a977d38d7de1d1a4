"""URL parts against the standard library, which defines them."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlparse

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lurewatch.functions.urls import base64_url_id, display_domain, link_facts, urls_in_text

HREFS = [
    "http://192.168.1.100/verify?token=a1", "https://bit.ly/x", "HTTP://EXAMPLE.com:8080/A%20B?q=1",
    "https://u:p@micros0ft.com/acc%6Funt", "http://cafe/x", "//host/p", "/only/path?q#f", "?q=1", "#f",
    "https://a_b.com/p%zz?x=1+2#frag", "http://[2001:DB8::1]:80/w;v=1", "https://h/a;b/c;d;e?f=g",
    "https://h/a%2Fb%3Fc%23d", "ftp://h/p;type=a", "tel:+1;x", "unknown:x;y", "https:////x", "https://",
    "a:b:c", "1a://x/y", "https://h?x", "https://h#x?y", "http://x.y:bad/z", " https://pad.example/ ",
    "ht\ntps://new.example/li\tne", "https://ż.pl/ą?ł", "https://xn--pple-43d.com", "https://a.xn--b.c/",
    "https://h/%C4%85%FF", "javascript:alert(1)", "https://user@info@host/p", "http://[fe80::A%25eth0]/x",
]


def facts(spark, hrefs):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hrefs)], "i int, href string")
    link = F.array(F.struct(F.lit("shown").alias("visible_text"), "href", F.lit(False).alias("from_text")))
    out = rows.select("i", link_facts(link)[0].alias("l")).select("i", "l.*").orderBy("i")
    return out.collect()


def expected(href):
    p = urlparse(unquote(href))
    return p.scheme, p.hostname or "", p.path, p.query, urlparse(href).scheme == "https"


def test_parts_match_the_standard_library(spark):
    for href, r in zip(HREFS, facts(spark, HREFS)):
        got = (r.scheme, r.domain, r.path, r.query, r.uses_https)
        assert got == expected(href), href
        assert not r.is_malformed


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("hHtps:/?#;@%+.-_2Fa1 é&=[]℀５BD", max_size=24), min_size=40, max_size=80))
def test_parts_of_arbitrary_text(spark, tails):
    hrefs = [prefix + t for t in tails for prefix in ("", "https://", "http://h")]
    for href, r in zip(hrefs, facts(spark, hrefs)):
        try:
            want = expected(href)
        except ValueError:
            assert r.is_malformed, repr(href)
            continue
        assert not r.is_malformed, repr(href)
        assert (r.scheme, r.domain, r.path, r.query, r.uses_https) == want, repr(href)


def test_malformed(spark):
    bad = [
        "http://[::1/x", "http://::1]/x", "http://[nope]/x", "http://u@[1.2.3.4]:5/x", "http://%5B::1]/x",
        "http://\u2100.example/x", "http://[1::2::3]/", "http://[1:2:3:4:5:6:7::8]/", "http://[::1%25]/", "http://[::1.2.3.04]/",
    ]
    for href, r in zip(bad, facts(spark, bad)):
        assert r.is_malformed, href
        with pytest.raises(ValueError):
            expected(href)
    good = ["http://[::]/", "http://[1:2:3:4:5:6:7::]/", "http://[::ffff:1.2.3.4]/", "http://[v1a.x]/", "http://\u00bd.example/"]
    for href, r in zip(good, facts(spark, good)):
        expected(href)
        assert not r.is_malformed, href


def test_flags(spark):
    rows = facts(spark, ["http://10.0.0.1/", "http://[::1]/", "http://cafe/", "http://t.co/", "http://t.ly/", "http://xn--a.b/"])
    assert [r.is_ip_based for r in rows] == [True, True, True, False, False, False]
    assert [r.is_shortened for r in rows] == [False, False, False, True, False, False]
    assert [r.is_punycode for r in rows] == [False] * 5 + [True]


def test_display_domain(spark):
    shown = {
        "https://X.com:8080/a": "x.com:8080", "see http://a.b/c": "a.b", "www.PayPal.com": "www.paypal.com",
        "login.microsoft.com": "login.microsoft", "Click here": "", "mail me a@b.co": "b.co", "HTTPS://x": "",
    }
    rows = spark.createDataFrame([(s,) for s in shown], "s string")
    for r in rows.select("s", display_domain(F.col("s")).alias("d")).collect():
        assert r.d == shown[r.s], r.s


def test_urls_in_text(spark):
    text = "a http://x.y/z). <https://q.r/s> 'http://t' http://u\u00a0v HTTP://no https://e.f!?"
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(urls_in_text(F.col("t")).alias("u")).first().u
    want = [re.sub(r"[.,;:!?)]+$", "", u) for u in re.findall(r"https?://[^\s<>\"']+", text)]
    assert found == want


def test_url_id(spark):
    import base64

    urls = ["https://a.b/c?d=é", "x" * 100, "", "??>>~~"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for r in df.select("u", base64_url_id(F.col("u")).alias("i")).collect():
        assert r.i == base64.urlsafe_b64encode(r.u.encode()).rstrip(b"=").decode()

"""The same queries as plain SQL for another engine, to check results against.

Rules are written here as joins and unions over long tables, where the jobs
work on arrays inside a mail's row; only the input columns and the fixed values
are shared.
"""

from __future__ import annotations

import re

from lurewatch.operators import reports
from lurewatch.operators.intel import CALL_SECONDS, CALLS_PER_DAY, URLS_PER_CALL
from lurewatch.rules import RuleSet, fixed
from lurewatch.rules.messages import MESSAGES, SIGNAL_MESSAGES
from lurewatch.sources import derived

RULES = RuleSet.builtin()


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    def one(v):
        return text(v) if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(map(one, row)) + ")" for row in rows)


def listed(items) -> str:
    return ", ".join(map(text, items))


def fill(template: str, *columns: str) -> str:
    parts = []
    for i, piece in enumerate(template.split("{}")):
        if piece:
            parts.append(text(piece))
        if i < len(columns):
            parts.append(f"CAST({columns[i]} AS VARCHAR)")
    return "concat(" + ", ".join(parts) + ")"


def one_of(column: str, results: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {text(k)} THEN {v}" for k, v in results.items()) + " END"


def points(column: str) -> str:
    return one_of(column, {k: str(v) for k, v in fixed.SEVERITY_POINTS.items()})


# --- inputs and intermediate tables -----------------------------------------

WITH: dict[str, str] = {}

WITH["mail"] = "SELECT {} FROM documents".format(
    ", ".join(f"{sql} AS {name}" for name, sql in derived.MAIL_SQL.items())
)
WITH["page_key"] = """
  SELECT doc_id, doc_id % (SELECT count(*) FROM pages) AS page_id FROM documents
  UNION
  SELECT doc_id, (doc_id * 7) % (SELECT count(*) FROM pages) FROM documents"""
WITH["anchor"] = f"""
  SELECT doc_id AS email_id, page_id AS pos,
         {derived.VISIBLE_SQL.format(page="page_id", url="url")} AS visible_text,
         {derived.HREF_SQL.format(page="page_id", url="url")} AS href
  FROM page_key JOIN pages USING (page_id)"""
WITH["html_text"] = """
  SELECT email_id, string_agg(visible_text, chr(10) ORDER BY pos) AS html_text
  FROM anchor GROUP BY email_id"""
WITH["text_url"] = r"""
  SELECT email_id, i - 1 AS pos, rtrim(found[i], '.,;:!?)') AS url
  FROM (SELECT email_id, regexp_extract_all(text_body, 'https?://[^\s<>"'']+') AS found FROM mail),
       LATERAL (SELECT unnest(generate_series(1, len(found))) AS i)"""
WITH["candidate"] = """
  SELECT email_id, 0 AS src, pos, trim(href) AS href, visible_text, FALSE AS from_text
  FROM anchor
  WHERE trim(href) <> '' AND NOT starts_with(trim(href), 'mailto:') AND NOT starts_with(trim(href), '#')
  UNION ALL
  SELECT email_id, 1, pos, url, url, TRUE FROM text_url"""
WITH["distinct_link"] = """
  SELECT email_id, row_number() OVER (PARTITION BY email_id ORDER BY src, pos) - 1 AS pos,
         href, visible_text, from_text
  FROM (SELECT *, row_number() OVER (PARTITION BY email_id, href ORDER BY src, pos) AS nth FROM candidate)
  WHERE nth = 1"""
WITH["url_split"] = r"""
  SELECT *, regexp_extract(rest, '^//([^/?#]*)', 1) AS authority,
         split_part(regexp_replace(rest, '^//[^/?#]*', ''), '#', 1) AS tail
  FROM (SELECT *, lower(regexp_extract(decoded, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme,
               regexp_replace(decoded, '^[A-Za-z][A-Za-z0-9+.\-]*:', '') AS rest
        FROM (SELECT *, CASE WHEN contains(href, '%')
                THEN url_decode(replace(regexp_replace(href, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|$)', '%25\1', 'g'), '+', '%2B'))
                ELSE href END AS decoded
              FROM distinct_link))"""
WITH["link_domain"] = rf"""
  SELECT email_id, pos, href, visible_text, from_text, scheme,
         lower(CASE WHEN contains(hostport, '[') THEN regexp_extract(hostport, '\[([^\]]*)', 1)
                    ELSE split_part(hostport, ':', 1) END) AS domain,
         CASE WHEN scheme IN ({listed(fixed.PARAM_SCHEMES)})
              THEN regexp_replace(split_part(tail, '?', 1), ';[^/]*$', '')
              ELSE split_part(tail, '?', 1) END AS path,
         CASE WHEN contains(tail, '?') THEN substr(tail, instr(tail, '?') + 1) ELSE '' END AS query
  FROM (SELECT *, regexp_replace(authority, '^.*@', '') AS hostport FROM url_split)"""
WITH["link"] = rf"""
  SELECT *,
         regexp_matches(domain, '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$')
           OR regexp_matches(domain, '^\[?[0-9a-fA-F:]+\]?$') AS is_ip_based,
         domain IN ({listed(fixed.FLAGGED_SHORTENERS)}) AS is_shortened,
         starts_with(domain, 'xn--') OR contains(domain, '.xn--') AS is_punycode,
         regexp_matches(href, '^(?i:https):') AS uses_https,
         CASE WHEN from_text THEN domain
              WHEN regexp_matches(visible_text, 'https?://[^/\s]')
                THEN lower(regexp_extract(visible_text, 'https?://([^/\s]+)', 1))
              ELSE lower(regexp_extract(visible_text, '(www\.)?[a-zA-Z0-9-]+\.[a-zA-Z]{{2,}}', 0)) END
           AS display_domain
  FROM link_domain"""

_at = lambda column: f"CASE WHEN contains({column}, '@') THEN lower(substr({column}, instr({column}, '@') + 1)) ELSE '' END"
WITH["sender"] = f"""
  SELECT *, {_at('from_address')} AS fd, {_at('reply_to')} AS rd, {_at('return_path')} AS pd,
         lower(from_display_name) AS shown,
         lower(regexp_extract(message_id, '@([^>]+)>?$', 1)) AS issued_by
  FROM mail"""
WITH["auth"] = "SELECT email_id, authentication_results, {} FROM mail".format(
    ", ".join(
        f"lower(regexp_extract(authentication_results, '(?i){m}\\s*=\\s*(\\w+)', 1)) AS {m}"
        for m in ("spf", "dkim", "dmarc")
    )
)
WITH["impersonated"] = f"""
  SELECT email_id, arg_min(name, idx) AS name
  FROM sender JOIN ({values((i, n) for i, n in enumerate(fixed.IMPERSONATION_NAMES))}) AS n(idx, name)
    ON contains(shown, name) AND NOT contains(fd, name)
  WHERE fd <> '' GROUP BY email_id"""
WITH["free_mail_brand"] = f"""
  SELECT DISTINCT email_id
  FROM sender JOIN ({values((n,) for n in fixed.IMPERSONATION_NAMES[:fixed.BRAND_NAME_COUNT])}) AS n(name)
    ON contains(shown, name)
  WHERE fd IN ({listed(fixed.FREE_MAIL_DOMAINS)})"""
WITH["link_word"] = f"""
  SELECT email_id, pos, arg_min(word, idx) AS word
  FROM link JOIN ({values((i, k) for i, k in enumerate(fixed.URL_KEYWORDS))}) AS k(idx, word)
    ON contains(lower(path || query), word)
  GROUP BY email_id, pos"""
WITH["brand"] = f"SELECT * FROM ({values((i, b.domain, b.name, b.label) for i, b in enumerate(RULES.brands))}) AS b(idx, brand_domain, brand, brand_label)"
WITH["exempt"] = f"SELECT * FROM ({values((d,) for d in RULES.exempt_domains)}) AS e(domain)"
WITH["seen_domain"] = """
  SELECT email_id, domain, min(seen) AS seen FROM (
    SELECT email_id, fd AS domain, -2 AS seen FROM sender
    UNION ALL SELECT email_id, rd, -1 FROM sender
    UNION ALL SELECT email_id, lower(domain), pos FROM link)
  WHERE domain <> '' GROUP BY email_id, domain"""
WITH["checked"] = r"""
  SELECT email_id, row_number() OVER (PARTITION BY email_id ORDER BY seen) - 1 AS pos, domain,
         regexp_extract(domain, '([^.]*\.)?[^.]*$', 0) AS base_domain,
         split_part(regexp_extract(domain, '([^.]*\.)?[^.]*$', 0), '.', 1) AS label
  FROM seen_domain ANTI JOIN exempt USING (domain)"""
WITH["brand_hit"] = f"""
  SELECT email_id, pos, domain, label, brand, brand_domain, brand_label, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY email_id, domain ORDER BY idx) AS nth
    FROM (SELECT *, levenshtein(label, brand_label) AS distance FROM checked, brand)
    WHERE distance BETWEEN 1 AND {fixed.MAX_BRAND_DISTANCE}
       OR (contains(label, brand_label) AND label <> brand_label
           AND regexp_matches(label, {text('|'.join(fixed.DOMAIN_KEYWORDS))})))
  WHERE nth = 1"""
WITH["attachment"] = f"""
  SELECT *, len(detected) > 1 AS has_double,
         extension IN ({listed(fixed.FLAGGED_EXTENSIONS)})
           OR list_has_any(detected, [{listed(fixed.FLAGGED_EXTENSIONS)}]) AS is_suspicious
  FROM (SELECT *, CASE WHEN len(labels) > 1 THEN '.' || labels[-1] ELSE '' END AS extension,
               CASE WHEN len(labels) > 2 THEN list_transform(labels[2:], lambda x: '.' || x)
                    ELSE CAST([] AS VARCHAR[]) END AS detected
        FROM (SELECT email_id, 0 AS pos, filename, content_type, size_bytes,
                     sha256(repeat('x', CAST(size_bytes AS INTEGER))) AS sha256,
                     string_split(lower(filename), '.') AS labels
              FROM mail WHERE filename IS NOT NULL))"""
WITH["risky"] = f"SELECT * FROM ({values(RULES.extensions.items())}) AS r(risky_extension, severity)"
WITH["mime"] = f"SELECT * FROM ({values((m, e) for m, es in fixed.MIME_EXTENSIONS.items() for e in es)}) AS m(mime, allowed)"
WITH["searchable"] = """
  SELECT email_id, lower(CASE WHEN subject = '' THEN body WHEN body = '' THEN subject
                              ELSE subject || chr(10) || body END) AS searchable
  FROM (SELECT email_id, subject, CASE WHEN text_body <> '' THEN text_body
                                       ELSE coalesce(html_text, '') END AS body
        FROM mail LEFT JOIN html_text USING (email_id))"""
_phrases = [
    (gi, g.key, g.severity, pi, p)
    for gi, g in enumerate(RULES.signals)
    for pi, p in enumerate(g.phrases)
]
WITH["phrase"] = f"SELECT * FROM ({values(_phrases)}) AS p(group_no, signal, severity, phrase_no, phrase)"
WITH["signal"] = f"""
  SELECT email_id, group_no, signal, severity,
         array_to_string(list(phrase ORDER BY phrase_no)[1:{fixed.EVIDENCE_PHRASES}], ', ') AS shown
  FROM searchable JOIN phrase ON contains(searchable, lower(phrase))
  GROUP BY email_id, group_no, signal, severity"""
WITH["signal_count"] = """
  SELECT email_id, count(*) AS n, string_agg(signal, ', ' ORDER BY signal) AS names
  FROM signal GROUP BY email_id"""


# --- rules ------------------------------------------------------------------
# name -> (analyzer, position, rule, extra keys, SELECT list parts, FROM ...)


def rule(source, where, category, severity, title, evidence, location, message, confidence=1.0,
         tags="", position="0", keys=()):
    description, advice = message
    return {
        "source": source, "where": where, "category": text(category), "severity": severity,
        "title": title, "evidence": evidence, "location": location, "description": description,
        "recommendation": advice, "confidence": str(confidence), "tags": text(tags) if not tags.startswith("$") else tags[1:],
        "position": position, "keys": keys,
    }


def said(name: str, *columns: str, advice: tuple[str, ...] = ()) -> tuple[str, str]:
    description, recommendation = MESSAGES[name]
    return fill(description, *columns), fill(recommendation, *advice)


def header_rule(where, severity, title, evidence, location, message, confidence=1.0):
    return rule("sender", where, "sender_identity", text(severity), text(title), evidence,
                text(location), said(message), confidence)


def auth_rule(where, severity, title, evidence, message, confidence=1.0):
    return rule("auth", where, "authentication", text(severity), text(title), evidence,
                text("Authentication-Results header"), said(message), confidence)


def link_rule(where, severity, title, evidence, message, confidence=1.0, tags="", source="link"):
    return rule(source, where, "links", text(severity), title, evidence,
                fill("Link: {}", "substr(href, 1, 100)"), message, confidence, tags, "pos", ("pos",))


def file_rule(source, where, severity, title, evidence, message, confidence=1.0, position="pos"):
    return rule(source, where, "attachments", severity, title, evidence,
                fill("Attachment: {}", "filename"), message, confidence, "", position, ("pos",))


_url = fill("URL: {}", "substr(href, 1, 100)")
_dots = "len(string_split(domain, '.')) - 1"
_names = "from_display_name"
WITH["hidden"] = """
  SELECT a.*, d AS hidden, i FROM attachment a,
    LATERAL (SELECT unnest(detected) AS d, unnest(generate_series(1, len(detected))) AS i)"""

FINDING_RULES: list[tuple[str, int, dict]] = [
    ("hdr_reply_to_mismatch", 0, header_rule(
        "rd <> '' AND fd <> '' AND rd <> fd", "medium", "Reply-To domain mismatch",
        fill("From domain: {}, Reply-To domain: {}", "fd", "rd"), "Reply-To header", "reply_to")),
    ("hdr_return_path_mismatch", 0, header_rule(
        "pd <> '' AND fd <> '' AND pd <> fd", "high", "Return-Path domain mismatch",
        fill("From domain: {}, Return-Path domain: {}", "fd", "pd"), "Return-Path header", "return_path")),
    ("hdr_missing_message_id", 0, header_rule(
        "message_id = ''", "low", "Missing Message-ID", text("Message-ID header is absent"),
        "Message-ID header", "no_message_id")),
    ("hdr_message_id_mismatch", 0, header_rule(
        "fd <> '' AND issued_by <> '' AND issued_by <> fd AND NOT ends_with(issued_by, '.' || fd)",
        "low", "Message-ID domain mismatch",
        fill("From domain: {}, Message-ID domain: {}", "fd", "issued_by"), "Message-ID header",
        "message_id", 0.5)),
    ("hdr_bad_date", 0, header_rule(
        "date IS NULL", "low", "Missing or invalid Date header",
        fill("Raw Date value: '{}'", "date_raw"), "Date header", "bad_date")),
    ("snd_display_impersonation", 1, rule(
        "sender JOIN impersonated USING (email_id)", "TRUE", "sender_identity", text("high"),
        text("Display name impersonation"),
        fill("Display name: '{}', From: {}", _names, "from_address"), text("From header"),
        said("display_name", "name", "fd"))),
    ("snd_brand_on_free_mail", 1, rule(
        "sender JOIN free_mail_brand USING (email_id)", "TRUE", "sender_identity", text("high"),
        text("Brand name in display name with free email domain"),
        fill("Display name: '{}', Domain: {}", _names, "fd"), text("From header"),
        said("brand_free_mail", "fd"))),
    ("snd_address_in_display", 1, header_rule(
        r"regexp_matches(shown, '[a-zA-Z]+@[a-zA-Z]+\.\w+')", "medium",
        "Email address in display name", fill("Display name: '{}'", _names), "From header",
        "address_in_name")),
    ("auth_missing", 2, auth_rule(
        "authentication_results = ''", "medium", "Missing Authentication-Results",
        text("Authentication-Results header is absent"), "auth_missing", 0.7)),
    ("auth_spf", 2, rule(
        "auth", "spf IN ('fail', 'softfail', 'none')", "authentication",
        one_of("spf", {"fail": "'high'", "softfail": "'medium'", "none": "'low'"}),
        one_of("spf", {"fail": "'SPF check failed'", "softfail": "'SPF soft fail'", "none": "'No SPF record'"}),
        "'spf=' || spf", text("Authentication-Results header"),
        tuple(one_of("spf", {r: text(MESSAGES[f"spf_{r}"][i]) for r in ("fail", "softfail", "none")}) for i in (0, 1)),
        one_of("spf", {"fail": "1.0", "softfail": "1.0", "none": "0.6"}))),
    ("auth_dkim", 2, rule(
        "auth", "dkim IN ('fail', 'none')", "authentication",
        one_of("dkim", {"fail": "'high'", "none": "'low'"}),
        one_of("dkim", {"fail": "'DKIM verification failed'", "none": "'No DKIM signature'"}),
        "'dkim=' || dkim", text("Authentication-Results header"),
        tuple(one_of("dkim", {r: text(MESSAGES[f"dkim_{r}"][i]) for r in ("fail", "none")}) for i in (0, 1)),
        one_of("dkim", {"fail": "1.0", "none": "0.5"}))),
    ("auth_dmarc", 2, rule(
        "auth", "dmarc IN ('fail', 'none')", "authentication",
        one_of("dmarc", {"fail": "'high'", "none": "'low'"}),
        one_of("dmarc", {"fail": "'DMARC check failed'", "none": "'No DMARC policy'"}),
        "'dmarc=' || dmarc", text("Authentication-Results header"),
        tuple(one_of("dmarc", {r: text(MESSAGES[f"dmarc_{r}"][i]) for r in ("fail", "none")}) for i in (0, 1)),
        one_of("dmarc", {"fail": "1.0", "none": "0.5"}))),
    ("auth_multi_fail", 2, auth_rule(
        "spf = 'fail' AND dmarc = 'fail'", "critical", "Multiple authentication failures",
        text("spf=fail, dmarc=fail"), "auth_multi")),
    ("lnk_domain_mismatch", 3, link_rule(
        "display_domain <> '' AND domain <> '' AND display_domain <> domain"
        " AND display_domain <> visible_text AND contains(display_domain, '.')", "critical",
        text("Link text domain differs from actual URL"),
        fill("Visible: {}, Actual: {}", "display_domain", "domain"), said("link_mismatch"))),
    ("lnk_ip_host", 3, link_rule("is_ip_based", "high", text("IP-based URL"), _url, said("link_ip"))),
    ("lnk_shortened", 3, link_rule(
        f"domain IN ({listed([*fixed.FLAGGED_SHORTENERS, *RULES.shorteners])})", "medium",
        text("Shortened URL"), fill("Shortener domain: {}", "domain"), said("link_short"))),
    ("lnk_http", 3, link_rule(
        "starts_with(href, 'http://')", "low", text("Link uses HTTP instead of HTTPS"), _url,
        said("link_http"))),
    ("lnk_punycode", 3, link_rule(
        "is_punycode", "high", text("Punycode domain"), fill("Domain: {}", "domain"),
        said("link_punycode"))),
    ("lnk_deep_subdomain", 3, link_rule(
        f"{_dots} >= 3", "medium", text("Excessive subdomains"), fill("Domain: {}", "domain"),
        said("link_subdomains", _dots), 0.7)),
    ("lnk_keyword", 3, link_rule(
        "TRUE", "low", fill("Suspicious keyword in URL: '{}'", "word"), _url,
        said("link_keyword", "word"), 0.5, "url-keyword", "link JOIN link_word USING (email_id, pos)")),
    ("dom_typosquat", 4, rule(
        "brand_hit", f"distance BETWEEN 1 AND {fixed.MAX_BRAND_DISTANCE}", "brand_impersonation",
        text("high"), fill("Possible typosquatting of {}", "brand"),
        fill("Domain: {}, Brand: {}, Distance: {}", "domain", "brand_domain", "distance"),
        fill("Domain: {}", "domain"),
        said("typosquat", "domain", "distance", "brand", "brand_domain", advice=("brand",)),
        tags="typosquatting", position="pos", keys=("domain",))),
    ("dom_brand_keyword", 4, rule(
        "brand_hit", f"NOT (distance BETWEEN 1 AND {fixed.MAX_BRAND_DISTANCE})",
        "brand_impersonation", text("medium"),
        fill("Suspicious domain containing {} brand name", "brand"),
        fill("Domain: {}, Brand: {}", "domain", "brand_domain"), fill("Domain: {}", "domain"),
        said("brand_keyword", "domain", "brand_label", advice=("brand",)), 0.7,
        "brand-keyword", "pos", ("domain",))),
    ("att_double_extension", 5, file_rule(
        "attachment", "has_double", text("critical"), text("Double file extension detected"),
        "concat('Filename: ', filename, ', Extensions: [''', array_to_string(detected, ''', '''), ''']')",
        said("double_extension", "filename", "array_to_string(detected, ', ')"))),
    ("att_suspicious_type", 5, file_rule(
        "attachment JOIN risky ON extension = risky_extension", "TRUE", "severity",
        fill("Suspicious file type: {}", "extension"),
        fill("Filename: {}, Extension: {}, MIME: {}", "filename", "extension", "content_type"),
        said("suspicious_type", "filename", "extension"))),
    ("att_hidden_extension", 5, file_rule(
        "hidden JOIN risky ON hidden = risky_extension", "hidden <> extension", "severity",
        fill("Hidden suspicious extension: {}", "hidden"),
        fill("Filename: {}, Hidden extension: {}", "filename", "hidden"),
        said("hidden_extension", "filename", "hidden"), position="pos + i / 1000.0")),
    ("att_mime_mismatch", 5, file_rule(
        "attachment", "extension <> '' AND content_type IN (SELECT mime FROM mime)"
        " AND extension NOT IN (SELECT allowed FROM mime WHERE mime = content_type)",
        text("medium"), text("MIME type mismatch"),
        fill("MIME: {}, Extension: {}", "content_type", "extension"),
        said("mime_mismatch", "content_type", "extension"), 0.7)),
    ("txt_signals", 6, rule(
        "signal", "TRUE", "content", "severity",
        fill("Phishing signal: {}", "replace(signal, '_', ' ')"),
        fill("Matched patterns: {}", "shown"), text("Email body/subject"),
        tuple(one_of("signal", {k: text(m[i]) for k, m in SIGNAL_MESSAGES.items()}) for i in (0, 1)),
        tags="$signal", position="group_no", keys=("signal",))),
    ("txt_multi_signal", 6, rule(
        "signal_count", f"n >= {fixed.MULTI_SIGNAL_MIN}", "content", text("high"),
        text("Multiple phishing signals detected"), fill("Categories: {}", "names"),
        text("Email body/subject"), said("multi_signal", "n", "names"), tags="multi-signal",
        position="1000")),
]
# Where a rule's findings come in the order of findings of one link or file.
_RULE_NO = {name: i for i, (name, _, _) in enumerate(FINDING_RULES)}


def _rule_select(name: str) -> str:
    r = next(r for n, _, r in FINDING_RULES if n == name)
    keys = ", ".join(("email_id", *r["keys"]))
    return (
        f"SELECT {keys}, {r['title']} AS title, {r['severity']} AS severity, "
        f"CAST({r['confidence']} AS DOUBLE) AS confidence, {r['evidence']} AS evidence, "
        f"{r['location']} AS location FROM {r['source']} WHERE {r['where']}"
    )


WITH["finding_row"] = " UNION ALL ".join(
    f"SELECT email_id, {analyzer} AS analyzer, floor({r['position']}) AS pos, {_RULE_NO[name]} AS rule_no, "
    f"CAST({r['position']} AS DOUBLE) AS fine_pos, "
    f"{r['title']} AS title, {r['category']} AS category, {r['severity']} AS severity, "
    f"{r['description']} AS description, {r['evidence']} AS evidence, "
    f"{r['recommendation']} AS recommendation, {r['location']} AS location, "
    f"CAST({r['confidence']} AS DOUBLE) AS confidence, {r['tags']} AS tags "
    f"FROM {r['source']} WHERE {r['where']}"
    for name, analyzer, r in FINDING_RULES
)
WITH["finding"] = f"""
  SELECT *, {points('severity')} AS points,
         CAST(row_number() OVER (PARTITION BY email_id ORDER BY analyzer, pos, rule_no, fine_pos) AS INTEGER) AS ordinal
  FROM finding_row"""
WITH["score"] = f"""
  SELECT email_id, CAST(least({fixed.MAX_SCORE}, coalesce(sum(points), 0)) AS DOUBLE) AS risk_score,
         CAST(count(points) AS INTEGER) AS finding_count
  FROM mail LEFT JOIN finding USING (email_id) GROUP BY email_id"""
WITH["level"] = (
    "SELECT *, CASE "
    + " ".join(f"WHEN risk_score <= {b} THEN '{n}'" for b, n in fixed.LEVEL_UPPER_BOUNDS)
    + f" ELSE '{fixed.LEVEL_ABOVE}' END AS risk_level FROM score"
)
WITH["category_score"] = """
  SELECT email_id, category, CAST(sum(points) AS DOUBLE) AS score,
         CAST(count(*) AS INTEGER) AS finding_count
  FROM finding GROUP BY email_id, category"""
WITH["contributor"] = """
  SELECT email_id, nth - 1 AS rank, title FROM (
    SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY points DESC, ordinal) AS nth FROM finding)
  WHERE nth <= 5"""
WITH["top"] = """
  SELECT email_id, string_agg(title, ' | ' ORDER BY rank) AS top_contributors
  FROM contributor GROUP BY email_id"""
WITH["result"] = """
  SELECT mail.*, risk_score, risk_level, finding_count,
         coalesce(top_contributors, '') AS top_contributors,
         concat('m', email_id, '.eml') AS file
  FROM mail JOIN level USING (email_id) LEFT JOIN top USING (email_id)"""
_id = "substr(sha256(concat_ws('|', CAST(email_id AS VARCHAR), file)), 1, 32)"
WITH["stored"] = f"""
  SELECT result.*, {_id} AS id, ts AS created_at FROM result JOIN events ON event_id = email_id"""
WITH["sample"] = "SELECT {} FROM documents JOIN labels USING (doc_id)".format(
    ", ".join(f"{sql} AS {name}" for name, sql in derived.SAMPLE_SQL.items())
)
WITH["answer"] = """
  SELECT event_id, user_id, (event_id * 7) % (2 * (SELECT count(*) FROM documents)) AS sample_id,
         event_id % 3 = 0 AS user_answer
  FROM events"""
WITH["graded"] = """
  SELECT event_id, user_id, sample_id, user_answer,
         coalesce(user_answer = is_phishing, FALSE) AS correct,
         coalesce(explanation, 'Unknown sample ID: ' || sample_id) AS explanation,
         coalesce(replace(indicators, '|', '; '), '') AS indicators
  FROM answer LEFT JOIN sample ON sample_id = id"""
WITH["user_score"] = """
  SELECT user_id, count(*) AS total, count(*) FILTER (correct) AS correct,
         count(*) FILTER (NOT correct) AS incorrect,
         round_even(count(*) FILTER (correct) / count(*) * 100, 1) AS score_percent
  FROM graded GROUP BY GROUPING SETS ((user_id), ())"""
_votes = lambda sql: ", ".join(f"{s} AS {n}" for n, s in sql.items())
WITH["domain_vote"] = f"""
  SELECT domain, {_votes(derived.HOST_VOTES_SQL)}
  FROM (SELECT DISTINCT {derived.HOST_SQL} AS domain FROM pages) WHERE length(domain) % 3 <> 0
  UNION ALL SELECT * FROM {derived.KNOWN_HOSTS_SQL}"""
_base64_url = lambda column: f"rtrim(translate(base64(encode({column})), '+/', '-_'), '=')"
WITH["url_vote"] = f"""
  SELECT {_base64_url('url')} AS url_id, {_votes(derived.URL_VOTES_SQL)},
         CASE WHEN page_id % 2 = 0 THEN 'news,blog' ELSE '' END AS categories
  FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)"""
WITH["hash_vote"] = """
  SELECT sha256(repeat('x', CAST(n_chars AS INTEGER))) AS sha256, CAST(n_chars % 7 AS INTEGER) AS malicious,
         0 AS suspicious, 40 AS harmless, 20 AS undetected,
         'tag1,tag2,tag3,tag4,tag5,tag6,tag7,tag8,tag9,tag10' AS categories
  FROM (SELECT DISTINCT n_chars FROM documents WHERE n_chars % 2 = 0)"""
WITH["threat"] = f"""
  SELECT url, {derived.THREAT_SQL} AS threat FROM pages WHERE page_id % 3 = 0
  UNION SELECT url, {derived.OTHER_THREAT_SQL} FROM pages WHERE page_id % 3 = 0"""
WITH["href"] = "SELECT DISTINCT href AS url FROM link WHERE href <> ''"


def _redacted(column: str) -> str:
    for label, pattern in fixed.SECRET_PATTERNS:
        column = f"regexp_replace({column}, {text(pattern)}, {text(f'[REDACTED {label}]')}, 'gi')"
    return column


def judge(source: str, key: str, votes: str) -> str:
    return f"SELECT s.*, v.* EXCLUDE ({key}, malicious, suspicious, harmless, undetected), v.malicious IS NOT NULL AS found, coalesce(v.malicious, 0) AS malicious, coalesce(v.suspicious, 0) AS suspicious, coalesce(v.malicious + v.suspicious + v.harmless + v.undetected, 0) AS total FROM {source} s LEFT JOIN {votes} v USING ({key})"


_malicious = f"malicious >= {fixed.MALICIOUS_MIN}"
_suspicious = f"(malicious >= {fixed.SUSPICIOUS_MALICIOUS_MIN} OR suspicious >= {fixed.SUSPICIOUS_VOTES_MIN})"
_status = f"CASE WHEN NOT found THEN 'Not found' WHEN {_malicious} THEN 'MALICIOUS' WHEN {_suspicious} THEN 'Suspicious' ELSE 'Clean' END"
_hash_status = f"CASE WHEN NOT found THEN 'Not found' WHEN {_malicious} THEN 'MALICIOUS' ELSE 'Clean' END"
_ratio = "CASE WHEN total = 0 THEN '0/0' ELSE concat(malicious, '/', total) END"

# --- report parts -----------------------------------------------------------
WITH["r_finding"] = f"SELECT * REPLACE ({_redacted('evidence')} AS evidence, {_redacted('location')} AS location) FROM finding"
WITH["r_link"] = f"SELECT * REPLACE ({_redacted('visible_text')} AS visible_text, {_redacted('href')} AS href) FROM link"
WITH["r_mail"] = f"""
  SELECT *, {_redacted('subject')} AS r_subject, CAST(risk_score AS INTEGER) AS n FROM result"""


def _agg(table: str, line: str, order: str, sep: str = "chr(10)") -> str:
    return f"coalesce((SELECT string_agg({line}, {sep} ORDER BY {order}) FROM {table} x WHERE x.email_id = m.email_id), '')"


def _html(column: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = f"replace({column}, '{plain}', '{entity}')"
    return column


def _joined(*lines: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(lines) + ")"


_cell = lambda c: f"replace({c}, '|', '\\|')"
_t = text


def _markdown() -> str:
    return _joined(
        _t("# Mail threat report"), "''",
        fill("**Risk score:** {}/100 ({})", "n", "upper(risk_level)"),
        fill("**Subject:** {}", "r_subject"),
        fill("**From:** {} <{}>", "from_display_name", "from_address"),
        fill("**Date:** {}", "date_raw"), "''",
        fill("## Findings ({})", "finding_count"), "''",
        _agg("r_finding", fill("{}. **{}** [{}] {} ({})", "ordinal", "title", "upper(severity)", "evidence", "recommendation"), "ordinal"),
        "''", _t("## Links"), "''", _t("| Text | Address | Domain |"), _t("| --- | --- | --- |"),
        _agg("r_link", fill("| {} | {} | {} |", _cell("visible_text"), _cell("href"), "domain"), "pos"),
        "''", _t("## Attachments"), "''", _t("| Name | Type | Bytes | SHA-256 |"),
        _t("| --- | --- | --- | --- |"),
        _agg("attachment", fill("| {} | {} | {} | {} |", _cell("filename"), "content_type", "size_bytes", "sha256"), "pos"),
        "''", _t(f"*{reports.FOOTER}*"),
    )


def _html_report() -> str:
    return _joined(
        _t("<!DOCTYPE html>"), _t('<html lang="en">'),
        _t(f'<head><meta charset="utf-8"><title>Mail threat report</title><style>{reports.STYLE}</style></head>'),
        _t("<body>"), _t("<h1>Mail threat report</h1>"),
        fill('<p class="score">{}/100 {}</p>', "n", "upper(risk_level)"),
        fill("<p>Subject: {}</p>", _html("r_subject")),
        fill("<p>From: {}</p>", _html("from_address")),
        _t("<table><tr><th>Severity</th><th>Finding</th><th>Evidence</th></tr>"),
        _agg("r_finding", fill("<tr><td>{}</td><td>{}</td><td>{}</td></tr>", "upper(severity)", _html("title"), _html("evidence")), "ordinal"),
        _t("</table>"), _t("<ul>"),
        _agg("r_link", fill("<li>{}</li>", _html("href")), "pos"),
        _agg("attachment", fill("<li>{}</li>", _html("filename")), "pos"),
        _t("</ul>"), _t(f"<footer>{reports.FOOTER}</footer>"), _t("</body>"), _t("</html>"),
    )


def _user_report() -> str:
    by_level = lambda i: one_of("risk_level", {k: _t(v[i]) for k, v in reports.VERDICTS.items()})
    listed_ = lambda items: _t("\n".join(f"- {x}" for x in items))
    return _joined(
        _t("# Is this mail phishing?"), "''",
        fill("**{}** ({}/100)", by_level(0), "n"), fill("Subject: {}", "r_subject"), "''",
        _t("## Simple Explanation"), "''", by_level(1),
        _agg("contributor", fill("- {}", "title"), "rank"), "''",
        _t("## What You Should Do"), "''",
        f"CASE WHEN risk_level = 'low' THEN {listed_(reports.CALM_ADVICE)} ELSE {listed_(reports.WARNING_ADVICE)} END",
        "''", _t(reports.FOOTER),
    )


def _struct(*fields: tuple[str, str]) -> str:
    return "{" + ", ".join(f"'{n}': {v}" for n, v in fields) + "}"


def _json_report() -> str:
    same = lambda *names: [(n, n) for n in names]
    many = lambda table, struct, order: f"coalesce((SELECT list({struct} ORDER BY {order}) FROM {table} x WHERE x.email_id = m.email_id), [])"
    finding = _struct(
        *same("title", "category", "severity", "description", "evidence", "recommendation", "location", "confidence"),
        ("tags", "CASE WHEN tags = '' THEN CAST([] AS VARCHAR[]) ELSE [tags] END"),
    )
    link = _struct(*same("visible_text", "href", "domain", "is_ip_based", "is_shortened", "is_punycode", "uses_https"))
    att = _struct(*same("filename", "content_type", "size_bytes", "sha256"), ("has_double_extension", "has_double"), ("is_suspicious_type", "is_suspicious"))
    return "CAST(to_json(" + _struct(
        *same("risk_score", "risk_level"),
        ("email_summary", _struct(("message_id", "message_id"), ("subject", "r_subject"), *same("from_address", "from_display_name", "date_raw"))),
        ("findings", many("r_finding", finding, "ordinal")),
        ("category_scores", many("category_score", _struct(*same("category", "score", "finding_count")), "category")),
        ("top_contributors", many("contributor", "title", "rank")),
        ("indicators", _struct(("links", many("r_link", link, "pos")), ("attachments", many("attachment", att, "pos")))),
    ) + ") AS VARCHAR)"


# --- queries ----------------------------------------------------------------

_summary = "id, file AS filename, subject, from_address, risk_score, risk_level, finding_count, top_contributors"
_or_dash = lambda c: f"CASE WHEN {c} = '' THEN '—' ELSE {c} END"


def _flag_list(*named: tuple[str, str]) -> str:
    joined = "concat_ws(' ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in named) + ")"
    return f"CASE WHEN {joined} = '' THEN '—' ELSE {joined} END"


_scan = """SELECT concat('maildrop/', email_id % 16, '/m', email_id, '.eml') AS path, email_id, file AS filename, from_address,
  CASE WHEN subject = '' THEN '—' ELSE subject END AS subject, risk_score,
  upper(risk_level) AS risk_level, finding_count, CAST(NULL AS VARCHAR) AS error,
  risk_score >= 50 AS flagged FROM result"""

_star = lambda column: rf"""CASE WHEN NOT contains({column}, '@') THEN {column} ELSE
  concat(CASE WHEN length(split_part({column}, '@', 1)) <= 2 THEN repeat('*', length(split_part({column}, '@', 1)))
         ELSE concat(left(split_part({column}, '@', 1), 1), repeat('*', length(split_part({column}, '@', 1)) - 2),
                     right(split_part({column}, '@', 1), 1)) END, '@', split_part({column}, '@', 2)) END"""

_spans = {(b + a): None for b, subs in fixed.CHAR_SUBSTITUTES.items() for a in subs}

_header = lambda name, value: f"CASE WHEN {value} <> '' THEN concat({text(name + ': ')}, {value}, chr(10)) ELSE '' END"
_body_start = f"CASE WHEN email_id % 5 = 2 THEN {text(f'--{derived.INNER}{chr(10)}Content-Type: ')} ELSE {text(f'--{derived.BOUNDARY}{chr(10)}Content-Type: ')} END"
_part_start = text(f"--{derived.BOUNDARY}\nContent-Type: ")
_anchor_tag = f"concat('<p><a href=\"', {_html('href')}, '\">', {_html('visible_text')}, '</a></p>')"
WITH["bytes"] = f"""
  SELECT email_id, strlen(concat(
    {_header('Return-Path', "CASE WHEN return_path <> '' THEN '<' || return_path || '>' ELSE '' END")},
    'Received: from ', relay, ' by in.company.com', chr(10),
    CASE WHEN email_id % 4 = 0 THEN concat('Received: from origin.example by ', relay, chr(10)) ELSE '' END,
    {_header('Authentication-Results', 'authentication_results')},
    CASE WHEN from_display_name <> '' OR from_address <> '' THEN concat('From: ',
      CASE WHEN from_display_name <> '' THEN concat('"', from_display_name, '" ') ELSE '' END,
      '<', from_address, '>', chr(10)) ELSE '' END,
    {_header('To', 'to_header')}, {_header('Cc', 'cc_header')}, {_header('Subject', "CASE WHEN email_id % 7 = 3 AND subject <> '' THEN concat('=?utf-8?B?', base64(encode(subject)), '?=') ELSE subject END")},
    CASE WHEN email_id % 3 = 0 THEN concat('X-Tag: one', chr(10), 'X-Tag: two', chr(10)) ELSE '' END,
    {_header('Date', 'date_raw')}, {_header('Message-ID', 'message_id')}, {_header('Reply-To', 'reply_to')},
    {text(f'MIME-Version: 1.0{chr(10)}Content-Type: multipart/mixed; boundary="{derived.BOUNDARY}"{chr(10)}{chr(10)}')},
    CASE WHEN email_id % 5 = 2 THEN {text(f'--{derived.BOUNDARY}{chr(10)}Content-Type: multipart/alternative; boundary="{derived.INNER}"{chr(10)}{chr(10)}')} ELSE '' END,
    {_body_start}, {text(f'text/plain; charset="utf-8"{chr(10)}Content-Transfer-Encoding: ')},
    CASE WHEN email_id % 6 = 0 THEN 'base64' ELSE '8bit' END, chr(10), chr(10),
    CASE WHEN email_id % 6 = 0 THEN base64(encode(text_body)) ELSE text_body END, chr(10),
    {_body_start}, {text(f'text/html; charset="utf-8"{chr(10)}Content-Transfer-Encoding: 8bit{chr(10)}{chr(10)}')},
    '<html><body>', chr(10), tags, chr(10), '</body></html>', chr(10),
    CASE WHEN email_id % 5 = 2 THEN {text(f'--{derived.INNER}--{chr(10)}')} ELSE '' END,
    CASE WHEN filename IS NOT NULL THEN concat({_part_start}, content_type, chr(10),
      'Content-Disposition: attachment; filename="', filename, '"', chr(10), chr(10),
      repeat('x', CAST(size_bytes AS INTEGER)), chr(10)) ELSE '' END,
    {text(f'--{derived.BOUNDARY}--{chr(10)}')})) AS length
  FROM mail JOIN (SELECT email_id, string_agg({_anchor_tag}, chr(10) ORDER BY pos) AS tags
                  FROM anchor GROUP BY email_id) USING (email_id)"""

QUERIES: dict[str, str] = {
    "mail_scan": """SELECT concat('maildrop/', email_id % 16, '/m', email_id, '.eml') AS path,
        concat('m', email_id, '.eml') AS name, length FROM bytes ORDER BY path""",
    "mail_intake_gate": f"""SELECT path, length, reject_reason, reject_reason IS NULL AS accepted FROM (
        SELECT path, length, CASE WHEN ends_with(path, '/') THEN 'bad_name'
          WHEN NOT regexp_matches(lower(path), '[^/]\\.eml$') THEN 'not_eml'
          WHEN length > {fixed.MAX_MAIL_BYTES} THEN 'too_large' END AS reject_reason
        FROM (SELECT {derived.UPLOAD_PATH_SQL} AS path, {derived.UPLOAD_LENGTH_SQL} AS length FROM documents))""",
    "mail_parse": """SELECT email_id, message_id, subject, from_address, from_display_name, reply_to,
        return_path, to_header AS to_list, cc_header AS cc_list, date, date_raw, 
        concat(relay, ' > in.company.com', CASE WHEN email_id % 4 = 0 THEN concat(', origin.example > ', relay) ELSE '' END) AS hops,
        CASE WHEN email_id % 3 = 0 THEN 'one, one' END AS tags, authentication_results, text_body, html_text,
        CAST(anchor_count AS INTEGER) AS anchor_count, '1.0' AS mime_version, filename,
        CASE WHEN filename IS NOT NULL THEN size_bytes END AS size_bytes,
        CASE WHEN filename IS NOT NULL THEN sha256(repeat('x', CAST(size_bytes AS INTEGER))) END AS sha256,
        CAST(NULL AS VARCHAR) AS parse_error
      FROM mail JOIN html_text USING (email_id)
        JOIN (SELECT email_id, count(*) AS anchor_count FROM anchor GROUP BY email_id) USING (email_id)""",
    "rule_tables": f"""SELECT rule_set, CAST(idx AS INTEGER) AS idx, rule_key, rule_value, coalesce(mails, 0) AS mails
      FROM (SELECT 'brand' AS rule_set, idx, brand_domain AS rule_key, brand AS rule_value FROM brand
            UNION ALL {values(("exempt_domain", i, d, "exempt") for i, d in enumerate(RULES.exempt_domains))}
            UNION ALL {values(("shortener", i, s, "shortener") for i, s in enumerate(RULES.shorteners))}
            UNION ALL {values(("extension", i, e, s) for i, (e, s) in enumerate(RULES.extensions.items()))}
            UNION ALL {values(("phrase", i, p[4], p[1]) for i, p in enumerate(_phrases))}) AS r
      LEFT JOIN (
        SELECT rule_set, rule_key, count(DISTINCT email_id) AS mails FROM (
          SELECT email_id, s.rule_set, domain AS rule_key FROM seen_domain, (VALUES ('brand'), ('exempt_domain')) s(rule_set)
          UNION ALL SELECT email_id, 'shortener', domain FROM link
          UNION ALL SELECT email_id, 'extension', extension FROM attachment
          UNION ALL SELECT email_id, 'phrase', phrase FROM searchable JOIN phrase ON contains(searchable, lower(phrase)))
        GROUP BY rule_set, rule_key) USING (rule_set, rule_key)""",
    "sample_table": """SELECT id, title, eml_filename, is_phishing, difficulty,
        CAST(len(string_split(indicators, '|')) AS INTEGER) AS indicator_count, replace(tags, '|', ',') AS tags FROM sample""",
    "analysis_sink": f"SELECT {_summary}, CAST(created_at AS DATE) AS ingest_date FROM stored",
    "analysis_history": """SELECT id, file AS filename, subject, from_address, risk_score, risk_level, created_at
      FROM stored ORDER BY created_at DESC, id LIMIT 50""",
    "analysis_detail": f"""SELECT w.id, s.id IS NOT NULL AS found, subject, from_address, risk_score, risk_level,
        created_at, CASE WHEN s.id IS NOT NULL THEN {_agg('finding', 'title', 'ordinal', "' | '").replace('m.email_id', 's.email_id')} END AS titles,
        message_id, CASE WHEN s.id IS NOT NULL THEN CAST((SELECT count(*) FROM link l WHERE l.email_id = s.email_id) AS INTEGER) END AS link_count
      FROM (SELECT DISTINCT {_id} AS id FROM (SELECT user_id AS email_id, concat('m', user_id, '.eml') AS file FROM events)) w
      LEFT JOIN stored s ON s.id = w.id""",
    "mail_stream": f"SELECT {_id} AS {_summary} FROM result",
    "link_extract_text": "SELECT email_id, CAST(pos AS INTEGER) AS pos, url FROM text_url",
    "link_extract_html": r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos,
        regexp_extract(found[i], 'href="([^"]*)"', 1) AS href,
        trim(replace(replace(replace(regexp_replace(found[i], '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS visible_text
      FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*"[^>]*>.*?</a>') AS found FROM pages),
           LATERAL (SELECT unnest(generate_series(1, len(found))) AS i)""",
    "link_dedup": "SELECT email_id, CAST(pos AS INTEGER) AS pos, href, visible_text, from_text FROM distinct_link",
    "link_parts": "SELECT email_id, CAST(pos AS INTEGER) AS pos, href, scheme, domain, path, query FROM link",
    "link_flags": "SELECT email_id, CAST(pos AS INTEGER) AS pos, href, is_ip_based, is_shortened, is_punycode, uses_https FROM link",
    "link_display_domain": "SELECT email_id, CAST(pos AS INTEGER) AS pos, visible_text, display_domain FROM link",
    "domain_of_address": "SELECT email_id, fd AS from_domain, rd AS reply_domain, pd AS return_domain FROM sender",
    "base_domain": "SELECT email_id, domain, base_domain, label FROM checked",
    "auth_results_parse": "SELECT email_id, spf, dkim, dmarc FROM auth",
    "dom_collect": "SELECT email_id, CAST(pos AS INTEGER) AS pos, domain FROM checked",
    "dom_exempt": "SELECT email_id, domain, domain IN (SELECT domain FROM exempt) AS is_exempt FROM seen_domain",
    "dom_char_substitution": f"""SELECT email_id, domain, arg_min(brand, idx) AS brand FROM (
        SELECT email_id, domain, brand, idx,
               list_filter(list_transform(generate_series(1, length(label)), lambda i: brand_label[i] || label[i]),
                           lambda p: p[1] <> p[2]) AS pairs
        FROM checked, brand WHERE length(label) = length(brand_label))
      WHERE len(pairs) BETWEEN 1 AND 2 AND list_has_all([{listed(_spans)}], pairs)
      GROUP BY email_id, domain""",
    "dom_levenshtein": r"""SELECT *, CAST(levenshtein(from_label, reply_label) AS INTEGER) AS distance FROM (
        SELECT email_id, split_part(regexp_extract(fd, '([^.]*\.)?[^.]*$', 0), '.', 1) AS from_label,
               split_part(regexp_extract(rd, '([^.]*\.)?[^.]*$', 0), '.', 1) AS reply_label FROM sender)""",
    "dom_brand_match": f"""SELECT DISTINCT domain, brand,
        CASE WHEN distance BETWEEN 1 AND {fixed.MAX_BRAND_DISTANCE} THEN 'typosquatting' ELSE 'brand-keyword' END AS rule,
        CASE WHEN distance BETWEEN 1 AND {fixed.MAX_BRAND_DISTANCE} THEN CAST(distance AS INTEGER) END AS distance
      FROM brand_hit""",
    "att_extensions": """SELECT email_id, pos, filename, extension, array_to_string(detected, ',') AS detected_extensions,
        has_double AS has_double_extension, is_suspicious AS is_suspicious_type FROM attachment""",
    "txt_searchable": "SELECT email_id, searchable FROM searchable",
    "findings_all": """SELECT email_id, ordinal, category, severity, title, description, evidence, recommendation,
        location, confidence, tags FROM finding""",
    "severity_points": """SELECT severity, points, count(*) AS finding_count, CAST(sum(points) AS BIGINT) AS total_points
      FROM finding GROUP BY severity, points""",
    "risk_score": "SELECT email_id, risk_score FROM score",
    "risk_level": "SELECT email_id, risk_level FROM level",
    "category_scores": "SELECT email_id, category, score, finding_count FROM category_score",
    "top_contributors": "SELECT email_id, CAST(rank AS INTEGER) AS rank, title FROM contributor",
    "analysis_result": """SELECT email_id, message_id, subject, from_address, risk_score, risk_level, finding_count,
        coalesce((SELECT string_agg(concat(category, ':', CAST(score AS INTEGER), ':', c.finding_count), ';' ORDER BY category)
                  FROM category_score c WHERE c.email_id = result.email_id), '') AS category_scores,
        top_contributors FROM result""",
    "corpus_scan": _scan,
    "corpus_scan_summary": f"""SELECT count(*) AS files, count(*) FILTER (flagged) AS flagged,
        count(*) FILTER (risk_level = 'ERROR') AS errors FROM ({_scan})""",
    "inspect_links": f"""SELECT email_id, CAST(pos AS INTEGER) AS pos, {_or_dash('visible_text')} AS text, domain,
        {_flag_list(('is_ip_based', 'IP'), ('is_shortened', 'Short'), ('NOT uses_https', 'HTTP'), ('is_punycode', 'Punycode'))} AS flags
      FROM link""",
    "inspect_attachments": f"""SELECT email_id, pos, filename, extension, printf('%.1f KB', size_bytes / 1024) AS size,
        {_flag_list(('has_double', 'Double ext'), ('is_suspicious', 'Suspicious'))} AS flags FROM attachment""",
    "findings_listing": f"""SELECT email_id, ordinal, upper(severity) AS severity, title,
        replace(category, '_', ' ') AS category, description,
        {_or_dash('evidence')} AS evidence FROM finding""",
    "analysis_summary": f"SELECT {_id} AS {_summary} FROM result",
    "report_json": f"SELECT m.email_id, {_json_report()} AS report FROM r_mail m",
    "report_markdown": f"SELECT m.email_id, {_markdown()} AS report FROM r_mail m",
    "report_html": f"SELECT m.email_id, {_html_report()} AS report FROM r_mail m",
    "report_user": f"SELECT m.email_id, {_user_report()} AS report FROM r_mail m",
    "quiz_grade": "SELECT event_id, user_id, sample_id, user_answer, correct, explanation FROM graded",
    "quiz_score": "SELECT user_id, total, correct, incorrect, score_percent FROM user_score",
    "quiz_verdict": "SELECT user_id, CASE "
    + " ".join(f"WHEN score_percent >= {b} THEN {text(v)}" for b, v in fixed.QUIZ_GRADES)
    + " END AS verdict FROM user_score WHERE user_id IS NOT NULL",
    "quiz_answer_detail": "SELECT event_id, sample_id, user_answer, correct, explanation, indicators FROM graded",
    "sample_analysis": """SELECT s.id, is_phishing, risk_score, risk_level, finding_count, top_contributors
      FROM sample s JOIN result r ON s.eml_filename = r.file""",
    "sample_detail": """SELECT s.id, title, description, difficulty, replace(tags, '|', ',') AS tags, subject, from_address,
        from_display_name, reply_to, return_path, to_header AS to_list, date_raw, text_body, authentication_results,
        CAST((SELECT count(*) FROM link l WHERE l.email_id = s.id) AS INTEGER) AS link_count,
        CAST((SELECT count(*) FROM attachment a WHERE a.email_id = s.id) AS INTEGER) AS attachment_count,
        coalesce((SELECT string_agg(href, ' ' ORDER BY pos) FROM link l WHERE l.email_id = s.id), '') AS hrefs,
        coalesce(filename, '') AS filenames
      FROM sample s JOIN mail ON email_id = s.id""",
    "sample_listing": "SELECT id, title, description, difficulty, replace(tags, '|', ',') AS tags FROM sample",
    "intel_domain_join": f"""SELECT domain, found, malicious, suspicious, total, {_malicious} AS is_malicious,
        {_suspicious} AS is_suspicious, {_ratio} AS detection_ratio, {_status} AS status
      FROM ({judge("(SELECT DISTINCT domain FROM link WHERE domain <> '')", 'domain', 'domain_vote')})""",
    "intel_url_verdict_join": f"""SELECT url, url_id, found, malicious, total, {_malicious} AS is_malicious,
        {_suspicious} AS is_suspicious, {_status} AS status, coalesce(reputation, 0) AS reputation, coalesce(categories, '') AS categories
      FROM ({judge(f"(SELECT url, {_base64_url('url')} AS url_id FROM href)", 'url_id', 'url_vote')})""",
    "intel_hash_join": f"""SELECT email_id, pos, filename, sha256, found, malicious, total, {_ratio} AS detection_ratio,
        {_hash_status} AS status, coalesce(categories, '') AS categories
      FROM ({judge("(SELECT email_id, pos, filename, sha256 FROM attachment)", 'sha256', 'hash_vote')})""",
    "intel_url_join": """SELECT url, threats IS NULL AS safe, threats IS NOT NULL AS is_dangerous,
        coalesce(threats, '') AS threats, CASE WHEN threats IS NULL THEN 'Safe' ELSE 'DANGEROUS' END AS status
      FROM href LEFT JOIN (SELECT url, string_agg(threat, ', ' ORDER BY threat) AS threats FROM threat GROUP BY url) USING (url)""",
    "intel_url_id": f"SELECT page_id, url, {_base64_url('url')} AS url_id FROM pages",
    "redact_secrets": f"SELECT doc_id AS email_id, {_redacted(derived.LEAKY_SQL)} AS redacted FROM documents",
    "redact_address": f"SELECT email_id, {_star('from_address')} AS sender, {_star('return_path')} AS bounce, {_star('from_display_name')} AS shown FROM mail",
    "text_normalize": r"""SELECT 'document' AS kind, doc_id AS id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS plain FROM documents
      UNION ALL SELECT 'page', page_id, regexp_replace(html, '<[^>]+>', '', 'g') FROM pages""",
}
QUERIES["dom_brand_table"] = QUERIES["dom_brand_match"]
QUERIES["quiz_score_stream"] = QUERIES["quiz_score"] + " WHERE user_id IS NOT NULL"
QUERIES["intel_url_calls"] = f"""SELECT url, n // {URLS_PER_CALL} AS call, CAST(n % {URLS_PER_CALL} AS INTEGER) AS place,
    n // {URLS_PER_CALL} // {CALLS_PER_DAY} AS day, CAST(n // {URLS_PER_CALL} % {CALLS_PER_DAY} * {CALL_SECONDS} AS INTEGER) AS second
  FROM (SELECT url, row_number() OVER (ORDER BY url) - 1 AS n FROM (SELECT url FROM pages WHERE url <> '' UNION SELECT url FROM href))"""
QUERIES["findings_own"] = """SELECT email_id, CAST(row_number() OVER (PARTITION BY email_id ORDER BY title)
    + (SELECT count(*) FROM finding f WHERE f.email_id = own.email_id) AS INTEGER) AS ordinal, title, severity, evidence, confidence
  FROM (SELECT email_id, 'Shouting' AS title, 'low' AS severity, CAST(n AS VARCHAR) AS evidence, CAST(1 AS DOUBLE) AS confidence
        FROM (SELECT email_id, length(said) - length(replace(said, '!', '')) AS n
              FROM (SELECT email_id, concat(subject, text_body) AS said FROM mail)) WHERE n >= 3
        UNION ALL SELECT email_id, 'Unsigned', 'info', '', 0.5 FROM mail WHERE message_id = '' AND from_display_name = '') own"""
for _name, _, _ in FINDING_RULES:
    QUERIES[_name] = _rule_select(_name).replace("SELECT email_id, pos,", "SELECT email_id, CAST(pos AS INTEGER) AS pos,")


def oracle_sql() -> dict[str, str]:
    """Each query with just the intermediate tables it uses."""
    same = {"txt_signals_table": "txt_signals"}
    return {name: _with(sql) for name, sql in (QUERIES | {n: QUERIES[o] for n, o in same.items()}).items()}


def _with(sql: str) -> str:
    needed: set[str] = set()

    def visit(body: str) -> None:
        for name in WITH:
            if name not in needed and re.search(rf"(FROM|JOIN|,)\s+{name}\b(?!')", body):
                needed.add(name)
                visit(WITH[name])

    visit(sql)
    if not needed:
        return sql
    # read in several places: computed once
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({WITH[n]})" for n in WITH if n in needed) + "\n" + sql

"""Every operator as a query over the given tables: `name -> f(spark, folder)`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lurewatch.functions import redaction, text
from lurewatch.functions.arrays import present, rows_of, string_array
from lurewatch.functions.urls import base64_url_id, urls_in_text
from lurewatch.operators import (
    analysis,
    attachments,
    authentication,
    brandbook,
    content,
    domains,
    headers,
    intel,
    links,
    listing,
    mailfacts,
    phrasebook,
    reports,
    sender,
    training,
)
from lurewatch.plans import corpus
from lurewatch.rules import RuleSet, rule_table
from lurewatch.session import shared_folder
from lurewatch.sources import derived, eml, store
from lurewatch.sources.derived import table
from lurewatch.sources.mailfiles import open_store
from lurewatch.streaming.quiz import read_scores, score_stream

Query = Callable[[SparkSession, str], DataFrame]
RULES = RuleSet.builtin()
REGISTERED: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTERED[function.__name__] = function
    return function


# --- shared inputs ----------------------------------------------------------


def _head_mail(spark: SparkSession, folder: str) -> DataFrame:
    """Header fields only: no text is read and nothing is looked up."""
    names = [n for n in derived.MAIL_SQL if n != "text_body"]
    return table(spark, folder, "documents").select(*derived.mail_columns(*names))


def _text_mail(spark: SparkSession, folder: str) -> DataFrame:
    return derived.mail_without_anchors(spark, folder)


def _link_mail(spark: SparkSession, folder: str) -> DataFrame:
    return mailfacts.with_links(derived.mail(spark, folder))


def _file_mail(spark: SparkSession, folder: str) -> DataFrame:
    return mailfacts.with_attachments(derived.mail_without_anchors(spark, folder))


def _analyzed(spark: SparkSession, folder: str) -> DataFrame:
    return _with_filename(corpus.analyze_mail(derived.mail(spark, folder)))


def _with_filename(mail: DataFrame) -> DataFrame:
    return mail.withColumn("filename", eml.file_name(derived.mail_path(F.col("email_id"))))


def _found(rows: DataFrame, finding: Column, *keys: str) -> DataFrame:
    """The rows for which a rule fired, with what a reader checks first."""
    return (
        rows.select(*keys, finding.alias("f"))
        .filter("f IS NOT NULL")
        .select(*keys, "f.title", "f.severity", "f.confidence", "f.evidence", "f.location")
    )


# --- scans and sinks --------------------------------------------------------


@query
def mail_scan(spark, folder):
    """The mails as files, listed and read in tasks; in path order."""
    target = derived.dropped_mail(spark, folder)
    scanned = eml.scan_mail(spark, target)
    path = F.substring("path", len(open_store(target)[1]) + 2, 1 << 20)
    rows = scanned.select(path.alias("path"), F.octet_length("content").cast("bigint").alias("length"))
    return rows.select("path", eml.file_name(F.col("path")).alias("name"), "length").orderBy("path")


@query
def mail_intake_gate(spark, folder):
    documents = table(spark, folder, "documents")
    files = documents.select(
        F.expr(derived.UPLOAD_PATH_SQL).alias("path"),
        F.expr(derived.UPLOAD_LENGTH_SQL).alias("length"),
    )
    judged = eml.with_intake_verdict(files)
    return judged.withColumn("accepted", F.col("reject_reason").isNull())


@query
def mail_parse(spark, folder):
    parsed = eml.parse_mail(derived.raw_mail(spark, folder))
    hops = F.transform("received_hops", lambda h: F.concat(h["from_host"], F.lit(" > "), h["by_host"]))
    return parsed.select(
        "email_id", "message_id", "subject", "from_address", "from_display_name", "reply_to",
        "return_path",
        F.array_join("to", ", ").alias("to_list"),
        F.array_join("cc", ", ").alias("cc_list"),
        "date", "date_raw",
        F.array_join(hops, ", ").alias("hops"),
        # a repeated header shows its first value as often as it is there
        F.array_join(F.try_element_at(F.col("raw_headers"), F.lit("X-Tag")), ", ").alias("tags"),
        "authentication_results", "text_body", "html_text",
        F.size("anchors").alias("anchor_count"),
        F.element_at(F.col("raw_headers"), "MIME-Version")[0].alias("mime_version"),
        F.get("files", F.lit(0))["filename"].alias("filename"),
        F.get("files", F.lit(0))["size_bytes"].alias("size_bytes"),
        F.get("files", F.lit(0))["sha256"].alias("sha256"),
        "parse_error",
    )


@query
def rule_tables(spark, folder):
    """Each rule with the number of mails it applies to."""
    mail = derived.mail(spark, folder)
    mail = content.with_signals(mailfacts.with_attachments(mailfacts.with_links(mail)), RULES)
    mail = mailfacts.with_sender_domains(mail)
    keyed = lambda name, keys: F.transform(
        F.array_distinct(keys), lambda k: F.struct(F.lit(name).alias("rule_set"), k.alias("rule_key"))
    )
    seen = F.concat(
        F.array("from_domain", "reply_domain"), F.transform("links", lambda l: l["domain"])
    )
    used = F.concat(
        keyed("brand", seen),
        keyed("exempt_domain", seen),
        keyed("shortener", F.transform("links", lambda l: l["domain"])),
        keyed("extension", F.transform("attachments", lambda a: a["extension"])),
        keyed("phrase", F.flatten(F.transform("signals", lambda s: s["phrases"]))),
    )
    counts = (
        rows_of(mail, item=used, name="u").groupBy("u").agg(F.count(F.lit(1)).alias("mails"))
    ).select("u.*", "mails")
    return (
        rule_table(spark, RULES)
        .join(counts, ["rule_set", "rule_key"], "left")
        .select("rule_set", "idx", "rule_key", "rule_value", F.coalesce("mails", F.lit(0)).alias("mails"))
    )


@query
def sample_table(spark, folder):
    s = derived.samples(spark, folder)
    return s.select(
        "id", "title", "eml_filename", "is_phishing", "difficulty",
        F.size("indicators").alias("indicator_count"), F.array_join("tags", ",").alias("tags"),
    )


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """Analyses with the time of their event as creation time; it is looked up before the analysis."""
    created = table(spark, folder, "events").select(
        F.col("event_id").alias("email_id"), F.col("ts").alias("created")
    )
    mail = derived.mail(spark, folder).join(created, "email_id", "left")
    analyzed = _with_filename(corpus.analyze_mail(mail))
    return store.to_stored(analyzed, F.col("created"))


def _summary_text(stored: DataFrame) -> DataFrame:
    return store.analysis_summary(stored).withColumn(
        "top_contributors", F.array_join("top_contributors", " | ")
    )


@query
def analysis_sink(spark, folder):
    """Store all analyses in batches, compact them, then read the table back."""
    target = shared_folder(spark, "analyses")
    stored = _stored(spark, folder)
    for part in range(3):
        store.store_analyses(stored.filter(F.col("email_id") % 3 == part), target, part)
    store.compact(spark, target)
    back = store.read_analyses(spark, target)
    return back.select(
        *store.SUMMARY_COLUMNS[:-1],
        F.array_join("top_contributors", " | ").alias("top_contributors"),
        "ingest_date",
    )


def _store(spark: SparkSession, folder: str) -> str:
    """A store of all analyses; its folder."""
    target = shared_folder(spark, "analyses")
    stored = _stored(spark, folder)
    store.store_analyses(stored, target, "documents")
    return target


@query
def analysis_history(spark, folder):
    """The first page, from the newest days of the store."""
    return store.analysis_history(spark, _store(spark, folder))


@query
def analysis_detail(spark, folder):
    """A look-up of one analysis per user, among them ids that do not exist."""
    events = table(spark, folder, "events").select("user_id").distinct()
    email_id, name = F.col("user_id"), eml.file_name(derived.mail_path(F.col("user_id")))
    wanted = events.select(store.analysis_id(email_id, name).alias("id"))
    found = store.analysis_details(spark, _store(spark, folder), wanted)
    return found.select(
        "id", "found", "subject", "from_address", "risk_score", "risk_level", "created_at",
        F.array_join(F.transform("findings", lambda f: f["title"]), " | ").alias("titles"),
        F.col("email.message_id").alias("message_id"),
        F.size("email.links").alias("link_count"),
    )


@query
def mail_stream(spark, folder):
    """The mails as dropped files: analyzed batch by batch, stored, read back."""
    from lurewatch.streaming.dropfolder import watch_drop_folder

    target = shared_folder(spark, "stream")
    watch_drop_folder(spark, derived.dropped_mail(spark, folder), target, f"{target}-checkpoint").awaitTermination()
    kept = _summary_text(store.read_analyses(spark, target))
    # a dropped file is known by its content; the tables know a mail by its number
    number = F.regexp_extract("filename", "[0-9]+", 0)
    return kept.withColumn("id", store.analysis_id(number, F.col("filename")))


# --- links and URLs ---------------------------------------------------------


@query
def link_extract_text(spark, folder):
    mail = _text_mail(spark, folder)
    return rows_of(mail, "email_id", item=urls_in_text(F.col("text_body")), pos="pos", name="url")


@query
def link_extract_html(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "html")
    read = eml.read_html_column(pages)
    return rows_of(read, "page_id", item="anchors", pos="pos", name="a").select(
        "page_id", "pos", "a.href", "a.visible_text"
    )


@query
def link_dedup(spark, folder):
    mail = mailfacts.with_distinct_links(mailfacts.with_link_candidates(derived.mail(spark, folder)))
    return rows_of(mail, "email_id", item="distinct_links", pos="pos", name="l").select(
        "email_id", "pos", "l.href", "l.visible_text", "l.from_text"
    )


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(_link_mail(spark, folder), "email_id", item="links", pos="pos", name="l")


@query
def link_parts(spark, folder):
    return _links(spark, folder).select(
        "email_id", "pos", "l.href", "l.scheme", "l.domain", "l.path", "l.query"
    )


@query
def link_flags(spark, folder):
    return _links(spark, folder).select(
        "email_id", "pos", "l.href", "l.is_ip_based", "l.is_shortened", "l.is_punycode", "l.uses_https"
    )


@query
def link_display_domain(spark, folder):
    return _links(spark, folder).select("email_id", "pos", "l.visible_text", "l.display_domain")


@query
def domain_of_address(spark, folder):
    mail = mailfacts.with_sender_domains(_head_mail(spark, folder))
    return mail.select("email_id", "from_domain", "reply_domain", "return_domain")


@query
def base_domain(spark, folder):
    return _checked(spark, folder).select(
        "email_id",
        "domain",
        text.base_domain(F.col("domain")).alias("base_domain"),
        domains.domain_label(F.col("domain")).alias("label"),
    )


# --- header, sender and authentication rules --------------------------------


def _register_mail_rules(rules: dict, prepare) -> None:
    for name, rule in rules.items():

        def run(spark, folder, rule=rule):
            return _found(prepare(_head_mail(spark, folder)), rule(), "email_id")

        REGISTERED[name] = run


_register_mail_rules(headers.HEADER_RULES, mailfacts.with_sender_domains)
_register_mail_rules(sender.SENDER_RULES, mailfacts.with_sender_domains)
_register_mail_rules(authentication.AUTH_RULES, authentication.with_auth_results)


@query
def auth_results_parse(spark, folder):
    mail = authentication.with_auth_results(_head_mail(spark, folder))
    return mail.select("email_id", "spf", "dkim", "dmarc")


# --- link rules -------------------------------------------------------------


def _register_link_rules() -> None:
    for name, rule in links.LINK_RULES.items():

        def run(spark, folder, rule=rule):
            return _found(_links(spark, folder), rule(F.col("l"), RULES), "email_id", "pos")

        REGISTERED[name] = run


_register_link_rules()


# --- domain rules -----------------------------------------------------------


def _domain_mail(spark: SparkSession, folder: str) -> DataFrame:
    mail = mailfacts.with_sender_domains(_link_mail(spark, folder))
    return domains.with_checked_domains(mail, RULES)


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    mail = _domain_mail(spark, folder)
    return rows_of(mail, "email_id", item="checked_domains", pos="pos", name="domain")


@query
def dom_collect(spark, folder):
    return _checked(spark, folder)


@query
def dom_exempt(spark, folder):
    """Every domain of a mail with whether the brands' own list exempts it."""
    mail = mailfacts.with_sender_domains(_link_mail(spark, folder))
    seen = F.array_except(
        F.concat(
            F.array("from_domain", "reply_domain"),
            F.transform("links", lambda l: F.lower(l["target_domain"])),
        ),
        string_array([""]),
    )
    return rows_of(mail, "email_id", item=seen, name="domain").withColumn(
        "is_exempt", F.col("domain").isin(RULES.exempt_domains)
    )


def _register_domain_rules() -> None:
    for name, rule in domains.DOMAIN_RULES.items():

        def run(spark, folder, rule=rule):
            mail = _domain_mail(spark, folder)
            hits = domains.brand_hits(F.col("checked_domains"), RULES)
            rows = rows_of(mail, "email_id", item=hits, name="d").filter("d.hit IS NOT NULL")
            return _found(
                rows.withColumn("domain", F.col("d.domain")), rule(F.col("d")), "email_id", "domain"
            )

        REGISTERED[name] = run


_register_domain_rules()


@query
def dom_char_substitution(spark, folder):
    """The predicate by itself: the first brand a domain resembles letter by letter."""
    brands = domains.brand_array(RULES)
    label = domains.domain_label(F.col("domain"))
    alike = F.filter(brands, lambda b: domains.has_char_substitution(label, b["label"]))
    return (
        _checked(spark, folder)
        .select("email_id", "domain", F.get(alike, F.lit(0))["name"].alias("brand"))
        .filter("brand IS NOT NULL")
    )


@query
def dom_levenshtein(spark, folder):
    """Edit distance between the sender's and the Reply-To domain's first labels."""
    mail = mailfacts.with_sender_domains(_head_mail(spark, folder))
    label = lambda name: domains.domain_label(F.col(name))
    return mail.select(
        "email_id",
        label("from_domain").alias("from_label"),
        label("reply_domain").alias("reply_label"),
        F.levenshtein(label("from_domain"), label("reply_domain")).alias("distance"),
    )


@query
def dom_brand_match(spark, folder):
    """Each distinct domain of the corpus that resembles a brand, and how."""
    distinct = _checked(spark, folder).select("domain").distinct()
    hit = domains.brand_hits(F.array("domain"), RULES)[0]["hit"]
    return (
        distinct.select("domain", hit.alias("hit"))
        .filter("hit IS NOT NULL")
        .select(
            "domain",
            F.col("hit.name").alias("brand"),
            F.when(domains.is_typosquat(F.col("hit")), "typosquatting")
            .otherwise("brand-keyword")
            .alias("rule"),
            F.when(domains.is_typosquat(F.col("hit")), F.col("hit.distance")).alias("distance"),
        )
    )


@query
def dom_brand_table(spark, folder):
    """The same from a table of brands, by variants of labels."""
    found = brandbook.brand_hits(_checked(spark, folder), brandbook.brand_table(spark, RULES)).filter("hit IS NOT NULL")
    near = domains.is_typosquat(F.col("hit"))
    return found.select(
        "domain", F.col("hit.name").alias("brand"),
        F.when(near, "typosquatting").otherwise("brand-keyword").alias("rule"), F.when(near, F.col("hit.distance")).alias("distance"),
    )


# --- attachments and content ------------------------------------------------


@query
def att_extensions(spark, folder):
    mail = _file_mail(spark, folder)
    return rows_of(mail, "email_id", item="attachments", pos="pos", name="a").select(
        "email_id",
        "pos",
        "a.filename",
        "a.extension",
        F.array_join("a.detected_extensions", ",").alias("detected_extensions"),
        "a.has_double_extension",
        "a.is_suspicious_type",
    )


def _register_attachment_rules() -> None:
    for name, rule in attachments.ATTACHMENT_RULES.items():

        def run(spark, folder, rule=rule):
            mail = _file_mail(spark, folder)
            files = rows_of(mail, "email_id", item="attachments", pos="pos", name="a")
            rows = rows_of(files, "email_id", "pos", item=rule(F.col("a"), RULES), name="f")
            return _found(rows, F.col("f"), "email_id", "pos")

        REGISTERED[name] = run


_register_attachment_rules()


@query
def txt_searchable(spark, folder):
    mail = content.with_searchable_text(derived.mail(spark, folder))
    return mail.select("email_id", "searchable")


def _signal_mail(spark: SparkSession, folder: str) -> DataFrame:
    return content.with_signals(derived.mail(spark, folder), RULES)


@query
def txt_signals(spark, folder):
    rows = rows_of(_signal_mail(spark, folder), "email_id", item="signals", name="s")
    return _found(
        rows.withColumn("signal", F.col("s.key")), content.signal_finding(F.col("s")), "email_id", "signal"
    )


@query
def txt_signals_table(spark, folder):
    """The same from a table of phrases, by their rarest pieces."""
    mail = phrasebook.with_signals(derived.mail(spark, folder), phrasebook.phrase_table(spark, RULES))
    rows = rows_of(mail, "email_id", item="signals", name="s").withColumn("signal", F.col("s.key"))
    return _found(rows, content.signal_finding(F.col("s")), "email_id", "signal")


@query
def txt_multi_signal(spark, folder):
    mail = _signal_mail(spark, folder)
    rows = rows_of(mail, "email_id", item=present(content.multi_signal()), name="f")
    return _found(rows, F.col("f"), "email_id")


# --- findings and scores ----------------------------------------------------


@query
def findings_all(spark, folder):
    return listing.findings_long(_analyzed(spark, folder)).select(
        "email_id", "ordinal", "category", "severity", "title", "description", "evidence",
        "recommendation", "location", "confidence", F.array_join("tags", ",").alias("tags"),
    )


@query
def severity_points(spark, folder):
    rows = listing.findings_long(_analyzed(spark, folder)).select(
        "severity", analysis.severity_points(F.col("severity")).alias("points")
    )
    return rows.groupBy("severity", "points").agg(
        F.count(F.lit(1)).alias("finding_count"), F.sum("points").alias("total_points")
    )


@query
def risk_score(spark, folder):
    return _analyzed(spark, folder).select("email_id", "risk_score")


@query
def risk_level(spark, folder):
    return _analyzed(spark, folder).select("email_id", "risk_level")


@query
def category_scores(spark, folder):
    return rows_of(
        _analyzed(spark, folder), "email_id", item="category_scores", name="c"
    ).select("email_id", "c.category", "c.score", "c.finding_count")


@query
def top_contributors(spark, folder):
    return rows_of(
        _analyzed(spark, folder), "email_id", item="top_contributors", pos="rank", name="title"
    )


@query
def analysis_result(spark, folder):
    per_category = F.transform(
        "category_scores",
        lambda c: text.fill("{}:{}:{}", c["category"], c["score"].cast("int"), c["finding_count"]),
    )
    return _analyzed(spark, folder).select(
        "email_id", "message_id", "subject", "from_address", "risk_score", "risk_level",
        "finding_count",
        F.array_join(per_category, ";").alias("category_scores"),
        F.array_join("top_contributors", " | ").alias("top_contributors"),
    )


@query
def corpus_scan(spark, folder):
    """The whole job, from mail bytes to the scan table."""
    return corpus.corpus_scan(corpus.analyze_raw(derived.raw_mail(spark, folder)))


@query
def corpus_scan_summary(spark, folder):
    return corpus.scan_summary(corpus.corpus_scan(_analyzed(spark, folder)))


@query
def inspect_links(spark, folder):
    return listing.inspect_links(_link_mail(spark, folder))


@query
def inspect_attachments(spark, folder):
    return listing.inspect_attachments(_file_mail(spark, folder))


@query
def findings_listing(spark, folder):
    return listing.findings_listing(_analyzed(spark, folder))


@query
def analysis_summary(spark, folder):
    return _summary_text(store.to_stored(_analyzed(spark, folder)))


def _shouting(batch):
    """A user's own analyzer: three exclamation marks or more."""
    counts = [t.count("!") for t in batch.column("searched").to_pylist()]
    return [[{"title": "Shouting", "severity": "low", "evidence": str(n)}] if n >= 3 else [] for n in counts]


def _unsigned(batch):
    """Another one: no message id, and no name shown."""
    rows = zip(batch.column("message_id").to_pylist(), batch.column("from_display_name").to_pylist())
    return [[{"title": "Unsigned", "severity": "info", "confidence": 0.5}] if not (i or n) else [] for i, n in rows]


@query
def findings_own(spark, folder):
    """Two analyzers in Python behind the seven, in one crossing."""
    mail = derived.mail(spark, folder).withColumn("searched", F.concat_ws("\n", "subject", "text_body"))
    own = analysis.batch_analyzer(["searched", "message_id", "from_display_name"], _shouting, _unsigned)
    found = corpus.analyze_mail(mail, RULES, [*analysis.DEFAULT_ANALYZERS, own])
    rows = rows_of(found, "email_id", "risk_score", item="findings", name="f").filter("f.category = 'python'")
    return rows.select("email_id", "f.ordinal", "f.title", "f.severity", "f.evidence", "f.confidence")


# --- reports ----------------------------------------------------------------


def _register_reports() -> None:
    for name in reports.REPORTS:

        def run(spark, folder, name=name):
            return reports.report(_analyzed(spark, folder), name)

        REGISTERED[name] = run


_register_reports()


# --- training ---------------------------------------------------------------


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    return training.grade(derived.quiz_answers(spark, folder), derived.samples(spark, folder))


@query
def quiz_grade(spark, folder):
    return _graded(spark, folder).select(
        "event_id", "user_id", "sample_id", "user_answer", "correct", "explanation"
    )


@query
def quiz_score(spark, folder):
    """Per user, and over everyone as the row without a user."""
    return training.quiz_score_with_total(_graded(spark, folder), "user_id").drop("of_all")


@query
def quiz_score_stream(spark, folder):
    """Per user, from answers as they arrive."""
    target = shared_folder(spark, "quiz")
    schema = table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    answers = derived.answers_of(events, table(spark, folder, "documents").count())
    score_stream(answers, derived.samples(spark, folder), target, f"{target}-checkpoint").awaitTermination()
    return read_scores(spark, target)


@query
def quiz_verdict(spark, folder):
    scores = training.quiz_score(_graded(spark, folder), "user_id")
    return scores.select("user_id", training.quiz_verdict(F.col("score_percent")).alias("verdict"))


@query
def quiz_answer_detail(spark, folder):
    return _graded(spark, folder).select(
        "event_id", "sample_id", "user_answer", "correct", "explanation",
        F.array_join("indicators", "; ").alias("indicators"),
    )


def _sample_file(mail: DataFrame) -> DataFrame:
    return mail.withColumn("eml_filename", eml.file_name(derived.mail_path(F.col("email_id"))))


@query
def sample_analysis(spark, folder):
    samples = derived.samples(spark, folder)
    mail = training.mail_of_samples(samples, _sample_file(derived.mail(spark, folder)))
    outcome = training.sample_analysis(samples, corpus.analyze_mail(mail))
    return outcome.select(
        "id", "is_phishing", "risk_score", "risk_level", "finding_count",
        F.array_join("top_contributors", " | ").alias("top_contributors"),
    )


@query
def sample_detail(spark, folder):
    samples = derived.samples(spark, folder)
    mail = training.mail_of_samples(samples, _sample_file(derived.mail(spark, folder)))
    detail = training.sample_detail(samples, mailfacts.normalize_mail(mail))
    return detail.select(
        "id", "title", "description", "difficulty",
        F.array_join("tags", ",").alias("tags"),
        "subject", "from_address", "from_display_name", "reply_to", "return_path",
        F.array_join("to", ", ").alias("to_list"),
        "date_raw", "text_body", "authentication_results", "link_count", "attachment_count",
        F.array_join(F.transform("links", lambda l: l["href"]), " ").alias("hrefs"),
        F.array_join(F.transform("attachments", lambda a: a["filename"]), " ").alias("filenames"),
    )


@query
def sample_listing(spark, folder):
    listed = training.sample_listing(derived.samples(spark, folder))
    return listed.withColumn("tags", F.array_join("tags", ","))


# --- reputation -------------------------------------------------------------


@query
def intel_domain_join(spark, folder):
    judged = intel.domain_verdicts(_link_mail(spark, folder), derived.domain_verdicts(spark, folder))
    return judged.select(
        "domain", "found", "malicious", "suspicious", "total", "is_malicious", "is_suspicious",
        "detection_ratio", "status",
    )


@query
def intel_url_verdict_join(spark, folder):
    judged = intel.url_verdicts(_link_mail(spark, folder), derived.url_verdicts(spark, folder))
    return judged.select(
        "url", "url_id", "found", "malicious", "total", "is_malicious", "is_suspicious", "status",
        "reputation", F.array_join("categories", ",").alias("categories"),
    )


@query
def intel_hash_join(spark, folder):
    judged = intel.hash_verdicts(_file_mail(spark, folder), derived.hash_verdicts(spark, folder))
    return judged.select(
        "email_id", "pos", "filename", "sha256", "found", "malicious", "total", "detection_ratio",
        "status", F.array_join("categories", ",").alias("categories"),
    )


@query
def intel_url_join(spark, folder):
    judged = intel.url_threats(_link_mail(spark, folder), derived.url_threats(spark, folder))
    return judged.select(
        "url", "safe", "is_dangerous", F.array_join("threats", ", ").alias("threats"), "status"
    )


@query
def intel_url_calls(spark, folder):
    """All URLs of pages and links in calls of 500, with their time."""
    pages = table(spark, folder, "pages").select("url")
    links = _links(spark, folder).select(F.col("l.href").alias("url"))
    return intel.url_calls(pages.unionByName(links))


@query
def intel_url_id(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", "url", base64_url_id(F.col("url")).alias("url_id"))


# --- redaction and text -----------------------------------------------------


@query
def redact_secrets(spark, folder):
    """Whole bodies with secrets of every kind appended by turns."""
    documents = derived.documents_spread(spark, folder)
    leaky = documents.select(
        F.col("doc_id").alias("email_id"), F.expr(derived.LEAKY_SQL).alias("body")
    )
    return leaky.select("email_id", redaction.redact_secrets(F.col("body")).alias("redacted"))


@query
def redact_address(spark, folder):
    mail = _head_mail(spark, folder)
    return mail.select(
        "email_id",
        redaction.redact_address(F.col("from_address")).alias("sender"),
        redaction.redact_address(F.col("return_path")).alias("bounce"),
        redaction.redact_address(F.col("from_display_name")).alias("shown"),
    )


@query
def text_normalize(spark, folder):
    pages = table(spark, folder, "pages")
    documents = derived.documents_spread(spark, folder)
    return (
        documents.select(
            F.lit("document").alias("kind"),
            F.col("doc_id").alias("id"),
            text.normalize_whitespace(F.col("text")).alias("plain"),
        )
    ).unionByName(
        pages.select(
            F.lit("page").alias("kind"),
            F.col("page_id").alias("id"),
            text.strip_html_tags(F.col("html")).alias("plain"),
        )
    )


def queries() -> dict[str, Query]:
    return dict(REGISTERED)

"""Nulls, empty and very long texts, repeated rows, empty tables, clashing columns: the defined results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import bpe, brown, decontaminate, langid, mih, pii, quality, simhash, tokenfile, toxicity

LONG = " ".join(f"w{i % 7919}" for i in range(60_000))
ROWS = [
    (1, "The first text has words.", "en"), (2, None, "en"), (3, "", None), (4, " \n", "de"), (5, LONG, "en"),
    (6, "The first text has words.", "en"), (1, "The first text has words.", "en"), (None, "no id here", None),
    (None, None, None), (7, "x" * 200_000, "de"), (8, "mail a@b.example.org now", "fr"),
]
#: Names the operators use for their results or inside.
CLASH = [
    "score", "SCORE2", "fingerprint", "component_id", "hits", "n_words", "contaminated", "token_ids", "decoded", "pii",
    "lang_pred", "row", "n_tokens", "word", "text_hash", "root", "label", "cross_entropy", "letters", "item_ids", "n_hit",
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    return frame.withColumns({c: F.lit("kept") for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(1, 1, 0), (None, 1, 1), (2, None, None), (99, 0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def by_id(frame, *columns):
    return sorted(((r.doc_id, *[r[c] for c in columns]) for r in frame.select("doc_id", *columns).collect()), key=repr)


def test_near_duplicates(docs, empty):
    found = simhash.near_duplicates(docs).select("doc_id", "component_id").collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert len(found) == len(ROWS)
    assert sorted(groups[1]) == [1, 1, 6]
    # null, empty and blank texts are alike, the one without an id too
    assert sorted(groups[2], key=repr) == [2, 3, 4, None]
    assert groups[None] == [None] and groups[5] == [5] and groups[7] == [7]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr) == [1, 2, 5, 7, 8, None]
    assert simhash.keep_one(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = [(1, "first text has words"), (2, None), (3, ""), (None, "no id here"), (1, "first text has words"), (9, "absent")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_benchmark(docs, benchmark)
    rows = by_id(found, "n_words", "n_hit", "item_ids", "contaminated")
    assert (1, 5, 4, [1], True) in rows and (None, 3, 3, [], True) in rows
    assert (2, 0, 0, [], False) in rows and (7, 1, 0, [], False) in rows
    assert len(rows) == len(ROWS) and set(docs.columns) <= set(found.columns)
    first = found.filter("doc_id = 6").first()
    assert [(h.start, h.end) for h in first.hits] == [(4, 24)]
    # the benchmark in many rounds gives the same
    rounds = decontaminate.find_benchmark(docs, benchmark, block_bytes=16)
    assert by_id(rounds, "n_words", "n_hit", "item_ids", "contaminated") == rows
    assert by_id(rounds.filter("n_hit > 0"), "hits") == by_id(found.filter("n_hit > 0"), "hits")
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert kept.first()["hits"] == "kept"
    assert decontaminate.find_benchmark(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_benchmark(empty, benchmark).count() == 0


def test_tokens(docs, empty):
    path = bpe.public_path("byte_bpe_multi_50k.tiktoken")
    found = bpe.add_tokens(docs, path).collect()
    assert len(found) == len(ROWS)
    for r in found:
        assert bytes(r.decoded) == (r.text or "").encode() and bool(r.token_ids) == bool(r.text)
    assert bpe.add_tokens(empty, path).count() == 0


def test_token_files(spark, docs, empty, tmp_path):
    path = bpe.public_path("byte_bpe_50k.json")
    tokenfile.write_tokens(docs, path, str(tmp_path / "t"), block_ids=100)
    rows = tokenfile.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    start = 0
    for r in rows:
        assert r.start == start and r.token_ids[-1] == 0
        start += len(r.token_ids)
    assert [len(r.token_ids) for r in rows if r.doc_id in (2, 3)] == [1, 1]
    tokenfile.write_tokens(empty, path, str(tmp_path / "none"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_personal_data(spark, docs, empty):
    found = pii.add_personal_data(docs)
    assert found.count() == len(ROWS)
    assert [s.kind for s in found.filter("doc_id = 8").first().pii] == ["email"]
    masked = pii.mask_personal_data(docs)
    assert masked.columns == docs.columns
    assert masked.filter("doc_id = 8").first().text == "mail <EMAIL> now"
    assert masked.filter("text IS NULL").count() == 2
    assert pii.add_personal_data(empty).count() == 0
    texts = [
        ("GB82 WEST 1234 5698 7654 32 AND", ["iban:0:27"]), ("GB83 WEST 1234 5698 7654 32", []), ("DE89370400440532013000.", ["iban:0:22"]),
        ("a@b.c_d@e.f", ["email:0:5", "email:5:11"]), ("é 4111 1111-1111 1111", ["card:2:21"]), ("4111111111111112", []),
        ("1.2.3.4.5.6.7.8 256.1.1.1", ["ip:0:7", "ip:8:15"]), ("+1 (168) 555-5254", ["phone:0:17"]), ("+12", []),
        ("x" * 100_000 + "@", []), ("1" * 100_000, []),
    ]
    rows = pii.add_personal_data(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, text string")).collect()
    for r in rows:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.pii] == texts[r.i][1], texts[r.i][0][:50]
    near = spark.createDataFrame([("my card 4111111111111111",), ("example 4111111111111111",)], "text string")
    assert [r.pii[0].score for r in pii.add_personal_data(near).collect()] == [0.9, 0.5]


def test_language(docs, empty):
    model = langid.train(docs)
    found = langid.add_language(docs, model)
    rows = by_id(found, "lang_pred", "score")
    assert len(rows) == len(ROWS) and (2, "und", 0.0) in rows and (4, "und", 0.0) in rows
    assert {r[1] for r in rows} <= {"de", "en", "fr", "und"} and all(0 <= r[2] <= 1 for r in rows)
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.add_language(docs, none).collect()} == {"und"}
    assert langid.add_language(empty, model).count() == 0
    assert langid.keep_known(docs).columns == docs.columns and langid.keep_known(empty).count() == 0


def test_class_scores(docs, empty):
    rows = by_id(brown.score(docs, docs), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert len(rows) == len(ROWS)
    assert {r[1:3] for r in rows if r[0] in (2, 3, 4)} == {(1, 1)}
    assert all(r[4] < 0 and r[5] <= 0 and r[1] == r[2] for r in rows)
    # told apart by a condition, the same
    same = by_id(brown.score(docs, F.lit(True)), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert [r[:4] for r in same] == [r[:4] for r in rows]
    assert all(abs(a[i] - b[i]) < 1e-6 for a, b in zip(same, rows) for i in (4, 5))
    unknown = by_id(brown.score(docs, empty), "n_known", "train_tokens", "base_score")
    assert {r[1:] for r in unknown} == {(0, 0, 0.0)}
    assert brown.score(empty, docs).count() == 0


def test_classifiers(docs, empty, labels):
    everything = F.lit(True)
    model = quality.train(docs, labels, "quality", everything, passes=2)
    lexicon = toxicity.learn(docs, labels, "toxic", everything)
    for found in (quality.add_score(docs, model), toxicity.add_score(docs, lexicon)):
        rows = found.collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    none = labels.limit(0)
    assert {r.score for r in quality.add_score(docs, quality.train(docs, none, "quality", everything, passes=1)).collect()} == {0.5}
    assert {r.score for r in toxicity.add_score(docs, toxicity.learn(docs, none, "toxic", everything)).collect()} == {0.0}
    assert quality.add_score(empty, model).count() == 0 and toxicity.add_score(empty, lexicon).count() == 0


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [0.5, 0.5], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [1.0, None], "a"),
        (6, [nan, 1.0], "a"), (7, [inf, 1.0], "a"), (8, [1.0], "a"), (None, [1.0, 1.0], "a"), (9, [2.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (20, [], "a"),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string").withColumn("score", F.lit(0))
    found = mih.nearest(table).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [
        (0, 1, 9, 2.0), (0, 2, 1, 1.0), (0, 3, 1, 1.0), (0, 4, 2, 0.5)]
    assert mih.nearest(table.limit(0)).count() == 0
    chunks = mih.nearest(table, every=1, query_bytes=16).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in chunks} == {0, 1, 2, 9}


def test_every_word_seen_twice_is_exchanged(spark, monkeypatch):
    monkeypatch.setattr(brown, "EXCHANGED", 8)
    texts = [f"the n{i} runs" for i in range(60)] * 2 + [f"to v{i} it" for i in range(60)] * 2
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = brown.train(docs, brown.word_counts(docs))
    index = brown.Index(model.known)
    nouns, verbs = ({int(model.classes[i]) for i in index.of([f"{kind}{i}" for i in range(60)])} for kind in "nv")
    assert len(model.known.hashes) == 125 and model.classes[-1] not in nouns | verbs
    assert not nouns & verbs


def test_token_files_hold_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    path = bpe.public_path("byte_bpe_50k.json")
    texts = ["one <|endoftext|> two", "<|endoftext|><|endoftext|>", "no <|endoftext |>", "", "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokenfile.write_tokens(docs, path, str(tmp_path / "t"))
    rows = tokenfile.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    whole = Tokenizer.from_file(path)
    assert [r.token_ids[:-1] for r in rows] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in rows[0].token_ids


def test_shuffled_letters_are_rejected_in_small_tables(spark):
    from zlib import crc32

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rng, ids = np.random.default_rng(0), [i for i in range(10**9, 10**9 + 400) if crc32(str(i).encode()) % 3 == 1]
    long = [r for r in rows if len(r.text or "") > 300][: len(ids)]
    noise = [(i, "".join(rng.permutation(list(r.text))), r.lang) for i, r in zip(ids, long)]
    docs = spark.createDataFrame([*map(tuple, rows), *noise], "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in langid.keep_known(docs).select("doc_id").collect()}
    assert len(noise) > 20 and sum(i in kept for i, _, _ in noise) < 0.05 * len(noise)
    assert sum(r.doc_id in kept for r in rows) > 0.98 * len(rows)


def test_pipeline_stages(spark, docs, tmp_path):
    """The rows above, with clashing columns, and an empty table, through all stages."""
    import corpus_pipeline

    named = docs.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    lessons = [(i, "the words of this text are plain and not long at all " * 3, "en") for i in range(100, 130)]
    taught = spark.createDataFrame(lessons, "doc_id bigint, text string, lang string")
    named = named.unionByName(taught, allowMissingColumns=True)
    for rows, folder in ((named, "some"), (named.limit(0), "none")):
        here = str(tmp_path / folder)
        rows.write.parquet(f"{here}/documents.parquet")
        items = spark.createDataFrame([(1, "mail a b example org now"), (2, None), (3, "")], "item_id bigint, text string")
        items.write.parquet(f"{here}/benchmark.parquet")
        state = spark.read.parquet(f"{here}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, state, here).write.parquet(f"{here}/{name}")
            state = spark.read.parquet(f"{here}/{name}")
            if name != "bpe":
                assert state.columns == rows.columns
        found = state.select("doc_id", "text", "root", "decoded").collect()
        if folder == "none":
            assert found == []
            continue
        ids = [r.doc_id for r in found]
        # null, empty and blank texts go, copies leave one, the contaminated one goes
        assert not {2, 3, 4, 6, 8} & set(ids) and 100 in ids and len(ids) == len(set(ids))
        assert all(r.root in ("kept", None) and bytes(r.decoded).decode() == r.text for r in found)


def test_personal_data_in_long_texts_with_many_matches(spark):
    """Sixteen times the matches take about sixteen times as long, not its square."""
    import time

    def took(n):
        text = " ".join(f"u{i}@x.org 10.0.{i % 256}.{i % 250}" for i in range(n))
        frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        start = time.time()
        assert frame.transform(pii.add_personal_data).select(F.size("pii")).first()[0] == 2 * n
        masked = pii.mask_personal_data(frame).first().text
        assert masked == " ".join(["<EMAIL> <IP>"] * n)
        return time.time() - start

    took(100)
    assert took(16_000) < 5 + 40 * took(1000)

"""The registered queries over whole small tables: against SQL, brute force, or held-out labels."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from lurewatch.llm import bpe, catalog, decontaminate, langid, oracle, simhash
from test_llm_units import plain_fingerprint, plain_scan

FOLDER = SMALL.replace("0.001", "0.01")
QUERIES = catalog.queries()


def table(name, folder=SMALL):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def result(spark, name, folder=SMALL):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


@pytest.mark.parametrize("name", list(oracle.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = con.execute(oracle.SQL[name])
    columns = [c[0] for c in found.description]
    want = Counter(tuple(row) for row in found.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in result(spark, name, FOLDER)) == want


def groups_of(prints: dict, distance=3) -> dict:
    """The smallest id reachable, by comparing all pairs."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ids):
        for b in np.flatnonzero(np.bitwise_count(values[a + 1 :] ^ values[a]) <= distance) + a + 1:
            x, y = find(i), find(ids[b])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_all_pairs(spark):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in table("documents")}
    want = groups_of(prints)
    found = result(spark, "op10_simhash")
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert all(int(r["fingerprint"], 16) == prints[r["doc_id"]] for r in found)


def test_a_large_bucket_loses_no_link(spark):
    """Many fingerprints that agree in most bits, compared in blocks of a few rows."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = set()
    for _ in range(700):
        flips = rng.choice(64, rng.integers(0, 9), replace=False)
        prints.add(int(base[rng.integers(0, 6)] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    distinct = spark.createDataFrame(signed, "fingerprint bigint")
    parts = [(list(range(0, 20)), 1), (list(range(20, 42)), 0), (list(range(42, 64)), 0)]
    edges = simhash.links(distinct, parts, 3, block_rows=16)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    want = groups_of({s: s % (1 << 64) for (s,) in signed})
    assert {i: found.get(i, i) for i in want} == want


def test_tokens_equal_the_libraries(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Ranks.load(path).tokens, special_tokens={}
    )
    found = {r["doc_id"]: r for r in result(spark, "op5_bpe")}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    written = {r["doc_id"]: r for r in result(spark, "op9_token_output")}
    start = 0
    for doc in sorted(table("documents"), key=lambda r: r["doc_id"]):
        text, row = doc["text"] or "", found[doc["doc_id"]]
        ids = library.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        own = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        row = written[doc["doc_id"]]
        assert (row["start"], row["n_tokens"]) == (start, len(own))
        assert row["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        start += len(own)


def test_nearest_finds_nine_in_ten(spark):
    rows = table("embeddings")
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found: dict = {}
    for r in result(spark, "op2_nearest"):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = asked = 0
    for q in ids[ids % 20 == 0]:
        scores = vectors @ vectors[ids == q][0]
        best = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        mine = sorted(found[q])
        assert [k for k, *_ in mine] == list(range(1, 21))
        assert all(abs(scores[ids == v][0] - s) < 1e-12 for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(ids[best]))
        asked += 20
    assert hits / asked >= 0.9


def test_class_scores_on_whole_texts(spark):
    from lurewatch.llm.brown import tokens

    counts: Counter = Counter()
    docs = table("documents", FOLDER)
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2:
            counts.update(tokens(d["text"]))
    total, kinds = sum(counts.values()), len(counts)
    found = {r["doc_id"]: r for r in result(spark, "op3_brown", FOLDER)}
    for d in docs:
        words, row = tokens(d["text"]), found[d["doc_id"]]
        base = sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert abs(row["base_score"] - base) < 1e-6
    held_out = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out)


def test_held_out_languages(spark):
    langs = {r["doc_id"]: r["lang"] for r in table("documents", FOLDER)}
    rows = [r for r in result(spark, "op4_language", FOLDER) if r["held_out"]]
    assert len(rows) > 200 and not any(r["rejected"] for r in rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) / len(rows) > 0.98


@pytest.mark.parametrize(("name", "label", "least"), [("op7_toxicity", "toxic", 0.94), ("op8_quality", "quality", 0.9)])
def test_held_out_labels(spark, name, label, least):
    labels = {r["doc_id"]: r[label] for r in table("labels", FOLDER)}
    rows = result(spark, name, FOLDER)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    known = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in known) / len(known) >= least


def test_pipeline_against_its_parts(spark, tmp_path):
    """What each stage keeps, by brute force over documents chosen for it, among the given ones."""
    docs = table("documents")
    item = table("benchmark")[0]["text"]
    top = max(d["doc_id"] for d in docs)
    added = [
        (top + 1, docs[0]["text"]), (top + 2, item), (top + 3, "1234 !!"), (top + 4, None),
        (top + 5, " ".join(reversed(docs[3]["text"].split())) + " mail me at someone@mail.example.org please"),
    ]
    extra = [{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": len(t or "")} for i, t in added]
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    spark.createDataFrame(docs + extra, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {d["doc_id"]: d["text"] for d in docs + extra}
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, state, str(tmp_path)).write.parquet(str(tmp_path / name))
        state = spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r for r in state.collect()}
        if name == "language_id":
            kept = {i: t for i, t in kept.items() if langid.symbols(t).any()}
        elif name == "simhash_dedup":
            groups = groups_of({i: plain_fingerprint(t) for i, t in kept.items()})
            kept = {i: t for i, t in kept.items() if groups[i] == i}
        elif name == "decontamination":
            built = decontaminate.automaton(items, 13)
            found = {i: decontaminate.scan(t, built) for i, t in kept.items()}
            assert all(found[i][0] == plain_scan(t, [])[0] for i, t in kept.items())
            kept = {i: t for i, t in kept.items() if 20 * sum(b - a for a, b in found[i][1]) < found[i][0]}
        if name != "bpe":
            assert state.columns == schema.names
        assert set(rows) == set(kept), name
    assert top + 1 not in rows and top + 2 not in rows and top + 3 not in rows and top + 4 not in rows
    assert "<EMAIL>" in rows[top + 5].text and "someone@" not in rows[top + 5].text
    assert all(bytes(r.decoded).decode() == r.text for r in rows.values())

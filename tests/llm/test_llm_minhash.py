"""MinHash near-duplicates against sets of shingles, all pairs compared."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from conftest import SMALL
from lurewatch.llm import catalog, minhash

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_set(text: str | None, words: int = 4) -> set[tuple[str, ...]]:
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    size = min(words, len(found))
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()


def plain_components(sets: dict, percent: int = 80) -> dict:
    """The smallest id reachable, from all pairs."""
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders: dict = {}
    for i in ids:
        for shingle in sets[i]:
            holders.setdefault(shingle, []).append(i)
    for b in ids:
        for a in {a for shingle in sets[b] for a in holders[shingle] if a < b}:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id bigint, text string, SET_KEY int, buckets string").write.parquet(f"{folder}/documents.parquet")
    found = catalog.queries()["op13_minhash"](spark, str(folder)).collect()
    sets = {i: plain_set(t) for i, t, *_ in rows}
    want = plain_components(sets)
    assert sorted(r.doc_id for r in found) == sorted(i for i, *_ in rows)
    for r in found:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    return want


def test_query_equals_all_pairs(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").to_pylist()}
    sets = {i: plain_set(t) for i, t in docs.items()}
    want = plain_components(sets)
    found = catalog.queries()["op13_minhash"](spark, SMALL.replace("0.001", "0.01")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}
    assert sum(c != i for i, c in want.items()) > 20


def words(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng: random.Random, text: list[str], times: int) -> list[str]:
    text = list(text)
    for _ in range(times):
        text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
    return text


def test_copies_of_a_base_and_chains(spark, tmp_path):
    """Copies that link to their base but hardly to one another; chains of small changes; short sets at the bound."""
    rng = random.Random(4)
    rows = []
    base = words(rng, 200)
    rows += [base, *(changed(rng, base, rng.randrange(4, 6)) for _ in range(150))]
    link = words(rng, 150)
    for _ in range(40):
        link = changed(rng, link, 3)
        rows.append(link)
    for n in (1, 2, 3, 4, 7, 8, 9, 12):
        short = words(rng, n)
        rows += [short, short, [*short, "more"], short[1:], [w.upper() for w in short]]
    passage = words(rng, 60)
    rows += [words(rng, 40) + passage + words(rng, 40) for _ in range(60)]
    listed = [(i, " ".join(r), 1, "b") for i, r in enumerate(rows)]
    listed += [(5000, None, 1, "b"), (5001, "", 1, "b"), (5002, " \t\n", 1, "b"), (5003, "　", 1, "b"), (5004, "a b", 1, "b")]
    rng.shuffle(listed)
    want = check(spark, listed, tmp_path)
    assert len({want[i] for i in range(151)}) == 1


def test_pairs_of_rounds_grow_with_the_group(spark, tmp_path, monkeypatch):
    """Copies of one base with few and with many changes: those that changed least are the hubs, and tell the others apart."""
    rng, copies = random.Random(11), 300
    base = words(rng, 150)
    rows = [(i, " ".join(changed(rng, base, 1 + i % 8)), 1, "b") for i in range(copies)]
    made, written = [], minhash.scratch

    def counted(frame, purpose):
        found = written(frame, purpose)
        if purpose == "minhash-tried":
            made.append(found.count())
        return found

    monkeypatch.setattr(minhash, "scratch", counted)
    want = check(spark, rows, tmp_path)
    # one component, and copies with too many changes that link to none
    assert copies / 10 < len(set(want.values())) < copies * 0.9
    assert sum(made) < copies, made


def test_only_rows_that_can_pair_are_dealt_out(spark, tmp_path, monkeypatch):
    """Sets alone in their buckets, further copies of a text, and buckets of two sets after their comparison."""
    rng = random.Random(12)
    base, shared = words(rng, 120), words(rng, 100)
    rows = [base] * 40 + [changed(rng, base, 1)] + [words(rng, 50) for _ in range(80)] + [[*words(rng, 30), *shared] for _ in range(2)]
    seen, written = [], minhash.scratch

    def noted(frame, purpose):
        found = written(frame, purpose)
        seen.append((purpose, found))
        return found

    monkeypatch.setattr(minhash, "scratch", noted)
    check(spark, [(i, " ".join(r), 1, "b") for i, r in enumerate(rows)], tmp_path)
    frames = dict(seen)
    let_through = {tuple(f.columns): f.count() for p, f in seen if p == "minhash-likely"}
    texts = next(n for columns, n in let_through.items() if "text" in columns)
    assert texts == frames["minhash-wanted"].count() < 6
    dealt = next(n for columns, n in let_through.items() if "bucket" in columns)
    assert frames["minhash-several"].count() <= dealt < 300 < frames["minhash-rows"].count()
    assert frames["minhash-alive"].count() > 10 and frames["minhash-rooted"].columns and all(
        f.count() == 0 for p, f in seen if p == "minhash-rooted" and "bucket" in f.columns
    )


def test_repeated_rows_and_rows_without_an_id(spark, tmp_path):
    text = "one two three four five six"
    rows = [(7, text), (7, text), (None, text), (9, text.upper()), (None, "alone here"), (None, None), (3, None), (3, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.queries()["op13_minhash"](spark, str(tmp_path)).collect()
    assert sorted(map(str, found)) == sorted(
        f"Row(doc_id={i}, n_shingles={n}, component_id={c}, kept={i == c})"
        for i, n, c in [(7, 3, 7), (7, 3, 7), (None, 3, 7), (9, 3, 7), (None, 1, None), (None, 0, None), (3, 0, 3), (3, 0, 3)]
    )


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c d e f")]])
def test_tables_without_pairs(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.queries()["op13_minhash"](spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.component_id, r.kept) for r in found] == [(i, i, True) for i, _ in rows]


def test_signatures_agree_as_sets_do():
    """Densified signatures agree in a share of bins that is the similarity, for few shingles and for many."""
    rng = np.random.default_rng(0)
    for size in (5, 20, 100, 1000):
        shares = []
        for _ in range(300):
            union = rng.integers(0, 2**64 - 1, size, dtype=np.uint64)
            one, other = np.sort(union[: size * 9 // 10]), np.sort(union[size // 10 :])
            shares.append(float((minhash.signature(one) == minhash.signature(other)).mean()))
            similar = len(np.intersect1d(one, other)) / size
        assert abs(np.mean(shares) - similar) < 0.05


def test_a_pair_at_the_bound_meets_in_a_bucket():
    rng = np.random.default_rng(1)
    missed = 0
    for size in (5, 10, 40, 300):
        for _ in range(1000):
            union = rng.integers(0, 2**64 - 1, size, dtype=np.uint64)
            one, other = np.sort(union[: size * 9 // 10]), np.sort(union[size - size * 9 // 10 :])
            assert size < 10 or minhash.similar(one, other, 80)
            if size >= 10:
                missed += not (minhash.buckets_of(minhash.signature(one)) == minhash.buckets_of(minhash.signature(other))).any()
    assert missed == 0

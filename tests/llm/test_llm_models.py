"""Learned models against plain versions: class bigrams, a lexicon scan, follow-the-regularised-leader in dictionaries."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import brown, quality, toxicity


def sentences(n, seed=3):
    """Texts in which nouns and verbs alternate, with some words that occur once."""
    rng = random.Random(seed)
    found = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(2, 9)):
            words += [f"noun{int(rng.paretovariate(0.7)) % 40}", f"verb{int(rng.paretovariate(0.7)) % 40}"]
        found.append(" ".join([*words, f"Once{i}"] if i % 3 == 0 else words))
    return found


@pytest.fixture()
def few_fixed(monkeypatch):
    monkeypatch.setattr(brown, "EXCHANGED", 6)
    monkeypatch.setattr(brown, "BLOCK", 50)
    monkeypatch.setattr(brown, "AT_ONCE", 400)


def test_class_scores_equal_a_plain_model(spark, few_fixed):
    texts = sentences(120)
    asked = [*texts[:25], None, "", "unknown words here", "noun1 Once0 noun1 unheard verb2", "NOUN1\tverb1\n"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = brown.word_counts(docs)
    seen = Counter(w for t in texts for w in brown.tokens(t))
    assert {r.word: r.n for r in counts.collect()} == dict(seen)
    model = brown.train(docs, counts)
    words = sorted(seen)
    place = brown.Index(model.known).of(words).tolist()
    assert all((p >= 0) == (seen[w] >= 2 or w == brown.END) for w, p in zip(words, place))
    rare = int(model.classes[-1])
    kind = {w: int(model.classes[p]) if p >= 0 else rare for w, p in zip(words, place)}
    # classes are the operator's; all probabilities are counted anew
    pairs, of_class = Counter(), Counter()
    for t in texts:
        line = [brown.END, *brown.tokens(t)]
        pairs.update((kind[a], kind[b]) for a, b in zip(line, line[1:]))
    size = rare + 1
    into, out = Counter(), Counter()
    for (a, b), n in pairs.items():
        out[a] += n
        into[b] += n
    for w, n in seen.items():
        of_class[kind[w]] += n if kind[w] != rare else 0
    once = sum(n for w, n in seen.items() if kind[w] == rare)
    kinds = sum(kind[w] == rare for w in seen)

    def plain(text):
        total, before = 0.0, kind[brown.END]
        for w in brown.tokens(text):
            c = kind.get(w, rare)
            share = (into[c] + 1) / (sum(pairs.values()) + size)
            total += math.log10((pairs[before, c] + brown.SMOOTH * share) / (out[before] + brown.SMOOTH))
            count = seen[w] + 1 if c == rare else seen[w]
            total += math.log10(count / (once + kinds + 1) if c == rare else count / of_class[c])
            before = c
        return total

    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string")
    same = brown.score(frame, docs)
    rows = {r.doc_id: r for r in same.collect()}
    assert len(rows) == len(asked)
    for i, text in enumerate(asked):
        assert abs(rows[i].score - plain(text)) < 1e-6, text


def test_passes_raise_the_likelihood(spark, few_fixed):
    texts = sentences(400, seed=9)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = brown.word_counts(docs)
    known = brown.vocabulary(counts)
    named = docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(True).alias("taught"), "text")
    ids = brown.encoded(named, known)
    words = len(known.hashes)
    start = np.append(np.arange(words) % 6, 6).astype(np.int32)
    start[6:-1] = 6
    found = []
    for passes in (1, 2, 4, 6):
        of, table = brown.follow(ids, start, 6, known.total, passes=passes)
        assert np.array_equal(table, brown.transitions(ids, of, 7)) and (of[:6] == start[:6]).all() and (of[6:-1] < 6).all()
        found.append(brown.likelihood(table))
    assert all(b >= a - 1e-6 for a, b in zip(found, found[1:])) and found[-1] > found[0]


def test_passes_do_not_read_the_texts_again(spark, few_fixed, monkeypatch):
    """Transitions after a pass are added up from blocks of neighbours; batches of texts are bounded only while they are read."""
    texts = sentences(300, seed=5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    read, whole, tables = [], brown.transitions, []
    monkeypatch.setattr(brown, "transitions", lambda *a: read.append(a[0]) or whole(*a))
    fit = brown.fit
    monkeypatch.setattr(brown, "fit", lambda known, of, table: tables.append((of, table)) or fit(known, of, table))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert brown.score(docs, F.lit(True)).count() == len(texts)
    assert len(read) == 1 and spark.conf.get(key) == before
    of, table = tables[0]
    assert np.array_equal(table, whole(read[0], of, len(table)))


def plain_measure(weights, exceptions, text):
    """Each word of the folded text by all entries; words inside an exception phrase left out."""
    words = [(m.start(), m.group()) for m in re.finditer(r"\S+", toxicity.fold(text))]
    line = toxicity.fold(text)
    spared = set()
    for phrase in exceptions:
        key = toxicity.fold(phrase)
        at = line.find(key)
        while key.strip() and at >= 0:
            spared |= set(range(at, at + len(key) - 1))
            at = line.find(key, at + 1)
    total = Counter()
    order = {e: i for i, e in enumerate(weights)}
    for at, word in words:
        fits = [e for e in weights if e == word or (e.endswith("*") and word.startswith(e[:-1]))]
        if fits and at - 1 not in spared:
            total[max(fits, key=lambda e: (weights[e], order[e]))] += 1
    return sum(weights[e] * (1 + math.log(n)) for e, n in total.items()), len(words)


def test_lexicon_equals_a_plain_scan():
    weights = {"trash": 2.0, "iowe*": 3.0, "ioser": 3.5, "tras*": 1.0, "abc": 2.0, "abcd*": 2.0}
    exceptions = ("trash can", "abc abc")
    built = toxicity.automaton(toxicity.Lexicon(weights, exceptions, None))
    rng = random.Random(1)
    pieces = ["trash", "TRASH", "can", "tr4sh", "loweiss", "loser", "l0ser!", "abc", "abcde", "trasher", "x", ",", "кan", "a" * 30, ""]
    for _ in range(500):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 25)))
        want = plain_measure(weights, exceptions, text)
        got = toxicity.measure(built, text)
        assert abs(got[0] - want[0]) < 1e-9 and got[1] == want[1], text


def test_more_of_the_same_never_lowers_a_score():
    rows = [(float(k % 3), 5.0 - k % 3, int(k % 3 == 0)) for k in range(90)]
    a, b, c = toxicity.fit(rows)
    assert b >= 0 and c >= 0
    for toxic, clean, share in ((5, 0, 0.1), (9, 4, 0.3), (3, 0, 0.5)):
        both = toxic + clean
        plain = 2 * (toxic * math.log(toxic / (both * share)) + (clean * math.log(clean / (both * (1 - share))) if clean else 0))
        assert abs(toxicity.evidence(toxic, clean, share) - plain) < 1e-9
    chosen = toxicity.select({"bad": (30, 0), "word": (20, 180), "rare": (3, 0), "some": (9, 40)}, 500, 100, 900)
    assert set(chosen) == {"bad"}


def test_leader_equals_a_plain_one(spark):
    texts = [(i, f"{'good fine words' if i % 2 else 'zz @@ zz junk'} number {i % 7} again again", i % 2) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, label int")
    labels = docs.select("doc_id", F.col("label").alias("quality"))
    model = quality.train(docs, labels, "quality", F.lit(True), passes=3)
    order = docs.select(
        "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(quality.SHARDS)).alias("shard"), F.xxhash64("doc_id", F.lit(2)).alias("turn")
    ).collect()
    known = {i: (t, y) for i, t, y in texts}
    shards: dict = {}
    for r in sorted(order, key=lambda r: (r.turn, r.doc_id)):
        shards.setdefault(r.shard, []).append(known[r.doc_id])
    z: dict = {}
    n: dict = {}
    for _ in range(3):
        seen: dict = {}
        for rows in shards.values():
            own_z, own_n = dict(z), dict(n)
            for text, label in rows:
                where, values = quality.features(text)
                x = list(zip(where.tolist(), values.astype(np.float32).astype(float).tolist()))
                weights = {}
                for i, _ in x:
                    zi = own_z.get(i, 0.0)
                    weights[i] = 0.0 if abs(zi) <= quality.L1 else -(zi - math.copysign(quality.L1, zi)) / (
                        (quality.BETA + math.sqrt(own_n.get(i, 0.0))) / quality.ALPHA + quality.L2)
                p = 1 / (1 + math.exp(-sum(weights[i] * v for i, v in x)))
                for i, v in x:
                    g = (p - label) * v
                    sigma = (math.sqrt(own_n.get(i, 0.0) + g * g) - math.sqrt(own_n.get(i, 0.0))) / quality.ALPHA
                    own_z[i] = own_z.get(i, 0.0) + g - sigma * weights[i]
                    own_n[i] = own_n.get(i, 0.0) + g * g
            for i in own_n:
                if own_n[i]:
                    seen.setdefault(i, []).append((own_z[i], own_n[i]))
        z = {i: sum(a for a, _ in v) / len(v) for i, v in seen.items()}
        n = {i: sum(b for _, b in v) / len(v) for i, v in seen.items()}
    assert set(np.flatnonzero(model.n).tolist()) == set(n)
    for i in n:
        assert abs(model.z[i] - z[i]) < 1e-4 * max(1, abs(z[i])) and abs(model.n[i] - n[i]) < 1e-4 * max(1, n[i])

"""The parts of the operators that need no Spark, against plainer versions."""

from __future__ import annotations

import itertools
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings, strategies as st

from lurewatch.llm import bpe, brown, decontaminate, langid, mih, pieces, quality, simhash, tokenfile, toxicity

LOWER = {c: c + 32 for c in range(65, 91)}
PATTERN = regex.compile(public_tokenizers.PATTERN)
ODD = st.lists(st.sampled_from([*"'sretvlmd 1aZ!.-\t\n\0", "\u00b2", "\u00e9", "\u00a0", "\u3000", "\u4e2d", "\U0001d4b3", "'re", "'ll ", "  "]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks.load(bpe.public_path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.tokens, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_pieces_and_ids_are_the_librarys(ranks, library, texts):
    for text in texts:
        assert pieces.cut(text) == PATTERN.findall(text)
    table = pieces.PieceTable(lambda new: bpe.merge(new, ranks))
    for _ in range(2):  # unknown, then known
        assert [x.tolist() for x in table.ids_of(texts)] == [library.encode_ordinary(t) for t in texts]


def test_a_full_table_starts_anew(ranks, library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    monkeypatch.setattr(pieces, "AT_ONCE", 20)
    table = pieces.PieceTable(lambda new: bpe.merge(new, ranks))
    texts = [" ".join(f"w{i * k % 97}antidisestablishment{i}" for i in range(60)) for k in range(1, 6)]
    assert [x.tolist() for x in table.ids_of(texts)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("piece", ["aaaaaaaaa" * 40, "é" * 300, "abcdefghij" * 500, "x" * 65, "y" * 64])
def test_long_pieces(ranks, library, piece):
    want = library.encode_ordinary(piece)
    assert bpe.merge_long(piece.encode(), ranks) == want
    assert bpe.merge([piece.encode()], ranks) == [want]
    assert bpe.decode(np.array(want), ranks) == piece.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300))
def test_packed_ids_come_back(ids):
    words, escapes = tokenfile.pack(np.array(ids, np.uint64))
    assert tokenfile.unpack(words, escapes).tolist() == ids
    assert len(escapes) == sum(i >= 2**60 for i in ids)
    # ids of 15 bits or less go at least three, four or more to a word
    if ids and max(ids) < 2**15:
        assert len(words) <= -(-len(ids) // 4) + 1


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(list("aBcÉ \t\n\x0b .")), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_nothing_and_of_much():
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    long = " ".join(f"w{i % 5000}" for i in range(150_000))
    assert simhash.fingerprint(long) == plain_fingerprint(long)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=5, max_size=5), min_size=1, max_size=4), st.integers(1, 4))
def test_allocation_is_the_best(costs, units):
    costs = [[0.0, *map(float, c)] for c in costs]
    every = [sum(c[u] for c, u in zip(costs, us)) for us in itertools.product(range(6), repeat=len(costs)) if sum(us) == units]
    total, given_ = simhash.allocate(costs, units)
    assert total == min(every) and sum(given_) == units
    assert total == sum(c[u] for c, u in zip(costs, given_))


def test_a_plan_for_nothing_is_small():
    parts = simhash.plan(0, np.zeros((64, 64)), 3)
    assert len(parts) == 4 and all(radius == 0 for _, radius in parts)


@pytest.mark.parametrize("count", [100, 10**6, 10**10])
def test_any_two_linked_fingerprints_meet_in_a_partition(count):
    rng = np.random.default_rng(count)
    bits = rng.random((500, 64)) < rng.random(64)
    together = bits.T.astype(float) @ bits * count / 500
    parts = simhash.plan(count, together, 3)
    assert sorted(b for group, _ in parts for b in group) == sorted({b for group, _ in parts for b in group})
    assert sum(radius + 1 for _, radius in parts) == 4
    for _ in range(3000):
        flipped = set(rng.choice(64, rng.integers(0, 4), replace=False).tolist())
        assert any(len(flipped & set(group)) <= radius for group, radius in parts)


def plain_scan(text, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    words, hit, found = split(text), set(), set()
    for item_id, item in items:
        own = split(item)
        size = min(window, len(own))
        for at in range(len(own) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[at : at + size]:
                    hit.update(range(i, i + size))
                    found.add(item_id)
    return len(words), len(hit), found


WORDS = st.lists(st.sampled_from(["a", "B", "b", "éa", "a1", "-", "a-b", "ab", " "]), max_size=30).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), WORDS)), max_size=4), st.integers(1, 5))
def test_scan_for_items(text, items, window):
    words, ranges, found = decontaminate.scan(text, decontaminate.automaton(items, window))
    assert (words, sum(b - a for a, b in ranges), found) == plain_scan(text, items, window)
    assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))


def test_codes_within_a_radius():
    rng = np.random.default_rng(1)
    for parts in (1, 3, 8, 9):
        stored, asked = (rng.integers(0, 256, (n, parts), dtype=np.uint8) for n in (200, 30))
        apart = np.bitwise_count(asked[:, None] ^ stored).sum(axis=2)
        index = mih.Index(stored)
        for radius in (0, 1, parts, 2 * parts + 1, 4 * parts, 8 * parts):
            assert (mih.within(asked, index, np.full(30, radius)) == (apart <= radius)).all()
        mixed = rng.integers(0, 8 * parts + 1, 30)
        assert (mih.within(asked, index, mixed) == (apart <= mixed[:, None])).all()


def test_kneser_ney_probabilities_sum_to_one():
    text = "the cat sat on the mat and the dog sat on the cat"
    grams, counts = np.unique(langid.windows(langid.symbols(text)), return_counts=True)
    model = langid.Backoff(grams, counts)
    signs = np.arange(1 << 16, dtype=np.uint64)
    for context in ("the", "sat", "zzz", "  t"):
        packed = np.uint64(sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context))) | signs
        assert abs(model.probability(packed).sum() - 1) < 1e-9


def test_language_of_short_and_odd_texts():
    found = {n: np.unique(langid.windows(langid.symbols(t)), return_counts=True) for n, t in {
        "en": "the quick brown fox jumps over the lazy dog and that is that with the other", "de": "der schnelle braune fuchs springt und das ist nicht schlecht für ein tier"}.items()}
    model = langid.build(sorted(found), found)
    assert langid.predict(model, "The other dog")[0] == "en"
    assert langid.predict(model, "NICHT für das")[0] == "de"
    for nothing in (None, "", " \n", "123 !?", "😀"):
        assert langid.predict(model, nothing)[:2] == ("und", 0.0)
    for odd in ("a", "中文", "𝒳", "x" * 100_000):
        name, score, bits, _ = langid.predict(model, odd)
        assert name in ("de", "en") and 0 <= score <= 1 and bits > 0


def likelihood(pairs, of):
    member = np.eye(of.max() + 1)[of]
    table = member.T @ pairs @ member
    parts = [x * np.log(np.maximum(x, 1e-300)) for x in (table, table.sum(axis=0), table.sum(axis=1))]
    return parts[0].sum() - parts[1].sum() - parts[2].sum()


@pytest.mark.parametrize("seed", range(4))
def test_exchange_ends_where_no_move_helps(seed):
    rng = np.random.default_rng(seed)
    pairs = np.floor(rng.random((14, 14)) ** 6 * 50)
    of = brown.exchange(pairs, 12, 3, passes=100)
    start = np.concatenate((np.arange(12) % 3, [3, 4]))
    assert of[12:].tolist() == [3, 4] and likelihood(pairs, of) > likelihood(pairs, start)
    for word, to in itertools.product(range(12), range(3)):
        other = of.copy()
        other[word] = to
        assert likelihood(pairs, other) <= likelihood(pairs, of) + 1e-5


def test_token_hashes_tell_tokens_apart():
    hashes = quality.token_hashes("Ab ab, AB cd ab\0 é!! é!!")
    assert len(hashes) == 11
    assert hashes[0] == hashes[1] == hashes[3] == hashes[5]
    assert len(set(hashes.tolist())) == 6
    assert len(quality.token_hashes(None)) == len(quality.token_hashes(" \n")) == 0


def test_regularised_leader_learns():
    model = quality.Model.empty()
    for i in range(200):
        model.learn(*quality.features(f"good fine text {i}"), 1)
        model.learn(*quality.features(f"*** junk *** {i}"), 0)
    weights = model.weights()
    assert quality.score(weights, "a good text") > 0.7 > 0.3 > quality.score(weights, "junk ***")
    assert 0 < quality.score(weights, None) < 1


def test_folding_and_exceptions():
    assert toxicity.fold("1d10T, ѕtup​íd!") == " idiot stupid "
    assert toxicity.fold(None) == toxicity.fold("!?") == " "
    lexicon = toxicity.Lexicon({"trash": 2.0, "iowe*": 3.0}, ("trash can",), (0.0, 1.0, 1.0))
    built = toxicity.automaton(lexicon)
    assert toxicity.measure(built, "Tr4sh! the trash can, loweiss lowe") == (2.0 + 3.0 * (1 + np.log(2)), 6)
    assert toxicity.without_single_words({"trash": (2.0, 9), "tras*": (1.0, 10), "iowe*": (3.0, 8), "ioweiei": (2.0, 2)}) == {
        "trash": 2.0, "iowe*": 3.0, "ioweiei": 2.0}
    assert toxicity.measure(built, "trashy alowe") == (0.0, 2)
    assert toxicity.measure(built, "") == (0.0, 0)
    assert toxicity.automaton(toxicity.Lexicon({}, (), None)) is None


@pytest.mark.parametrize("seed", range(4))
def test_gains_are_what_moves_add_to_the_likelihood(seed):
    rng = np.random.default_rng(seed)
    pairs = np.floor(rng.random((14, 14)) ** 6 * 50)
    of = np.concatenate((rng.permutation(np.arange(12) % 4), [3, 3]))  # some are still in the class of rare words, 3
    member = np.eye(4)[of]
    self_ = np.diag(pairs).copy()
    apart = pairs - np.diag(self_)
    found = brown.gains(apart @ member, apart.T @ member, self_, of, member.T @ pairs @ member)
    for word in range(14):
        likelihoods = []
        for to in range(3):
            other = of.copy()
            other[word] = to
            likelihoods.append(likelihood(pairs, np.append(other, 3)[:14]) if 3 in other else np.nan)
        likelihoods = np.array(likelihoods)
        assert np.allclose(np.diff(found[word]), np.diff(likelihoods))


def test_few_words_of_a_rich_vocabulary_share_a_coordinate():
    where, _ = quality.features(" ".join(f"word{i}" for i in range(20_000)))
    assert len(where) > 0.92 * 40_000 and quality.PASSES >= 6


def test_cells_of_words_add_up_without_sorting(monkeypatch):
    import numpy as np

    from lurewatch.llm import brown

    rng = np.random.default_rng(3)
    size, count = 9, 4000
    table = rng.integers(1, 500, (size, size)).astype(float)
    of = rng.integers(0, size, 300).astype(np.int32)
    word, cell, n = np.sort(rng.integers(0, 299, count)), rng.integers(0, 2 * size + 1, count), rng.integers(1, 40, count)
    keys, where = np.unique(word * (2 * size + 1) + cell, return_inverse=True)
    sums = np.bincount(where, n)

    def refuse(*args, **kwargs):
        raise AssertionError("sorted")

    monkeypatch.setattr(brown.np, "unique", refuse)
    want = brown.better(keys // (2 * size + 1), keys % (2 * size + 1), sums, of, brown.Steps(table))
    mixed = rng.permutation(count)
    for order in (np.arange(count), mixed):
        got = brown.better(word[order], cell[order], n[order], of, brown.Steps(table))
        assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert len(want[0])


def test_gains_take_logarithms_of_cells_and_not_of_all_classes(monkeypatch):
    """Words beside few classes: the sums over cells are plain sums of steps, and a mass that many words have is worked out once."""
    rng = np.random.default_rng(6)
    words, own = 3000, 90
    table = rng.integers(1, 900, (own + 1, own + 1)).astype(float)
    after, before = np.zeros((2, words, own + 1))
    for counts in (after, before):
        for _ in range(3):
            counts[np.arange(words), rng.integers(0, own + 1, words)] += rng.integers(1, 3, words)
    after[0], before[1] = rng.integers(0, 60, (2, own + 1))
    self_, old = (rng.random(words) < 0.01).astype(float), np.full(words, own)
    steps = brown.Steps(table)
    want = np.zeros((words, own))
    for side, counts in enumerate((after, before)):
        for w in range(words):
            d = np.flatnonzero(counts[w])
            want[w] += steps.of(side, counts[w, d], d).sum(axis=0, dtype=float)
    found = np.stack([steps.summed(s, *np.nonzero(c), c[np.nonzero(c)], words) for s, c in enumerate((after, before))]).sum(axis=0, dtype=float)
    assert np.allclose(found, want, rtol=1e-5, atol=1e-4)
    taken, f = [], brown._f
    monkeypatch.setattr(brown, "_f", lambda x: taken.append(np.size(x)) or f(x))
    brown.gains(after, before, self_, old, table, steps)
    assert sum(taken) < words * own / 2, sum(taken)

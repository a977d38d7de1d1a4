"""Language models against a plain Kneser-Ney in dictionaries, with few languages and with many."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lurewatch.llm import langid


class Plain:
    """Interpolated Kneser-Ney over the last letters of four-letter windows, by the book."""

    def __init__(self, texts):
        self.levels = [Counter()]
        for t in texts:
            s = "".join(map(chr, langid.symbols(t).tolist()))
            self.levels[0].update(s[i : i + 4] for i in range(len(s) - 3))
        for _ in range(3):
            self.levels.append(Counter(g[1:] for g in self.levels[-1]))
        self.discounts, self.totals, self.kinds = [], [], []
        for level in self.levels:
            n = Counter(level.values())
            self.discounts.append(n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5)
            total, kinds = defaultdict(int), defaultdict(int)
            for g, c in level.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.totals.append(total)
            self.kinds.append(kinds)

    def probability(self, window: str) -> float:
        p = 1 / 65536
        for k in (3, 2, 1, 0):
            g = window[k:]
            total = self.totals[k].get(g[:-1])
            if total:
                c, d = self.levels[k].get(g, 0), self.discounts[k]
                p = d * self.kinds[k][g[:-1]] / total * p + (max(c - d, 0) / total if c else 0)
        return p

    def bits(self, text: str) -> float:
        s = "".join(map(chr, langid.symbols(text).tolist()))
        found = [self.probability(s[i : i + 4]) for i in range(len(s) - 3)]
        return -sum(map(math.log2, found)) / len(found)


def made_up(languages: int, texts: int, seed: int = 0):
    """Texts of languages with alphabets and syllables of their own."""
    rng = random.Random(seed)
    rows = []
    for k in range(languages):
        letters = [chr(0x61 + rng.randrange(26)) for _ in range(8)] + [chr(0x4E00 + 50 * k + i) for i in range(6)]
        syllables = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(25)]
        for _ in range(texts):
            words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(30)]
            rows.append((len(rows), " ".join(words), f"l{k:03d}"))
    return rows


@pytest.mark.parametrize(("languages", "texts", "cells"), [(4, 25, 1 << 23), (4, 25, 3000), (100, 4, 200_000)])
def test_cross_entropies_equal_a_plain_model(spark, languages, texts, cells):
    rows = made_up(languages, texts)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, part_cells=cells)
    assert (len(model.parts) == 1) == (cells == 1 << 23) and model.languages == sorted({r[2] for r in rows})
    from zlib import crc32

    plain = {
        name: Plain([t for i, t, n in rows if n == name and crc32(str(i).encode()) % 10 != 7]) for name in model.languages
    }
    asked = [*rows[:: max(1, len(rows) // 20)], (10**6, "some other words 中文", None), (10**6 + 1, "12 !", None), (10**6 + 2, None, None)]
    frame = spark.createDataFrame([(i, t, 1) for i, t, _ in asked], "doc_id bigint, text string, Letters int")
    found = {r.doc_id: r for r in langid.add_language(frame, model).collect()}
    assert len(found) == len(asked)
    for i, text, _ in asked:
        row = found[i]
        if not text or not langid.symbols(text).any():
            assert (row.lang_pred, row.score, row.cross_entropy) == ("und", 0.0, None)
            continue
        bits = np.array([plain[n].bits(text) for n in model.languages])
        assert row.lang_pred == model.languages[int(bits.argmin())]
        assert abs(row.cross_entropy - bits.min()) < 1e-4


def test_ties_go_to_the_first_language(spark):
    texts = ["one and the same", "again the same words"]
    rows = [(i, t, lang) for lang in ("b", "a", "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for cells in (1 << 23, 1):
        found = langid.add_language(docs, langid.train(docs, part_cells=cells)).collect()
        assert {r.lang_pred for r in found} == {"a"} and all(abs(r.score - 1 / 3) < 1e-6 for r in found)


def test_noise_is_rejected_without_a_calibration(spark):
    """Too few documents to hold any back."""
    from zlib import crc32

    ids = [i for i in range(300) if crc32(str(i).encode()) % 10 != 7 and crc32(str(i).encode()) % 3 != 1][:6]
    rows = [(i, "the cat and the dog sat on the mat with the other cats " * 3, "en") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert model.levels == [None]
    found = langid.add_language(spark.createDataFrame([(1, "the other cat sat on the dog"), (2, "qzxj vkpw gqzr jxkv zzqj")], "i int, text string"), model)
    assert {r.i: r.no for r in found.select("i", langid.rejected(model).alias("no")).collect()} == {1: False, 2: True}

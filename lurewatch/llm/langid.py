"""Language identification by interpolated Kneser-Ney character models.

Text is reduced to lower-case letters with single spaces. Four-letter windows of
all training documents are counted where they are read and summed by Spark; lower
orders follow from them as continuation counts, as Kneser-Ney asks. A language's
model gives each window the interpolated probability of its last letter; the
windows of some languages are kept in one sorted array of hashes, as many languages
together as fit a bounded number of cells. Texts meet these parts of a model one after
another, and what each says of a text is put together; no window is left out. A text
gets the language of least cross-entropy per letter. It is rejected if that is nearer to what
held-back training documents have after their letters were shuffled than to what
they have as they are; the shorter a text, the more it may deviate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from lurewatch.llm.common import add_from_text, drop_clashing, once, remainder, scratch

ORDER = 4
#: Windows times languages in one part of a model, unless one language has more.
PART_CELLS = 1 << 23
#: Distinct windows a task holds before it hands on their counts.
HELD = 1 << 21
UNKNOWN = "und"
#: A language's levels are weighed against those of all languages together, as if these were so many documents of its own.
POOLED_WEIGHT = 50
RESULT = "lang_pred string, score double, cross_entropy double, letters bigint"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """Symbol of every code point: a letter stands for itself, all else is a space; 16 bits."""
    table = np.full(0x110000, 32, np.uint16)
    for code in range(0x110000):
        if chr(code).isalpha():
            # letters beyond 16 bits share symbols of the private area, 256 to one
            table[code] = code if code < 0x10000 else 0xE000 + (code >> 8 & 0xFFF)
    return table


def symbols(text: str | None) -> np.ndarray:
    """The letters of a text, lowered, words apart by one space, three spaces before and one after; empty if it has none."""
    if not text:
        return np.zeros(0, np.uint16)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    found = once("letters", 0, _letters)[codes]
    blank = found == 32
    blank[1:] &= blank[:-1]
    blank[0] = found[0] == 32
    found = found[~blank]
    if not len(found):
        return found
    return np.concatenate((np.full(ORDER - 1, 32, np.uint16), found, np.full(int(found[-1] != 32), 32, np.uint16)))


def windows(found: np.ndarray) -> np.ndarray:
    """Every ORDER symbols in a row, packed into 64 bits, the last in the lowest 16."""
    if len(found) < ORDER:
        return np.zeros(0, np.uint64)
    wide = found.astype(np.uint64)
    n = len(found) - ORDER + 1
    packed = wide[:n].copy()
    for k in range(1, ORDER):
        packed <<= np.uint64(16)
        packed |= wide[k : k + n]
    return packed


# --- counting -----------------------------------------------------------------


def window_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): how often each window occurs in a language's documents.

    A task adds up its own counts before they are shuffled, and hands them on when
    it holds HELD windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(where, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)

        def rows(name: str, grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"]
            )

        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(name, []).append(windows(symbols(text)))
            for name, packed in texts.items():
                grams, counts = np.unique(np.concatenate(packed), return_counts=True)
                parts = held.setdefault(name, [])
                parts.append((grams, counts.astype(np.float64)))
                if len(parts) > 8:
                    held[name] = [add_up(parts)]
            for name, parts in held.items():
                if sum(len(g) for g, _ in parts) > HELD:
                    yield rows(name, *add_up(parts))
                    held[name] = []
        for name, parts in held.items():
            if parts:
                yield rows(name, *add_up(parts))

    counted = docs.select(lang, text).mapInArrow(run, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# --- the model ------------------------------------------------------------------


@dataclass
class Part:
    """Some languages of a model."""

    languages: list[str]
    #: Hashes of the windows known in any of the languages, sorted, and where each run of equal leading bits begins.
    hashes: np.ndarray
    begins: np.ndarray
    #: log2 probability of a window's last letter, per known window and language.
    costs: np.ndarray
    #: The same by order, for windows that are not known: per language sorted contexts and grams.
    lower: list[Backoff]


@dataclass
class Model:
    """The languages in order, dealt to parts."""

    parts: list[Part]
    #: Per language the cross-entropy of its texts and of shuffled ones, if calibrated.
    levels: list[tuple[float, float] | None]

    @property
    def languages(self) -> list[str]:
        return [name for part in self.parts for name in part.languages]

    @property
    def ceiling(self) -> float:
        """Bits per letter of letters drawn evenly from those known."""
        kinds = [len(m.grams[0]) for part in self.parts for m in part.lower]
        return float(np.log2(max(kinds, default=1) + 1))


LEAD = 18


def mixed(grams: np.ndarray) -> np.ndarray:
    """A reversible hash, so that leading bits are even."""
    h = grams * MIX
    h ^= h >> np.uint64(29)
    return h * MIX


def find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(known, asked)
    at[at == len(known)] = 0
    return at, (known[at] == asked) if len(known) else np.zeros(len(asked), bool)


class Backoff:
    """One language's Kneser-Ney model of all orders, over packed windows."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams: list[np.ndarray] = []
        self.share: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.rest: list[np.ndarray] = []
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order].astype(np.float64)
        levels = []
        for k in range(ORDER, 0, -1):
            levels.append((grams, counts))
            if k > 1:
                # continuation counts: in how many kinds of longer windows a shorter one ends
                grams, kinds = np.unique(grams & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
                counts = kinds.astype(np.float64)
        for grams, counts in reversed(levels):
            once_, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once_ / (once_ + 2 * twice) if once_ and twice else 0.5
            contexts, where = np.unique(grams >> np.uint64(16), return_inverse=True)
            total = np.bincount(where, counts, len(contexts))
            kinds = np.bincount(where, minlength=len(contexts))
            self.grams.append(grams)
            self.share.append((counts - discount) / total[where])
            self.contexts.append(contexts)
            self.rest.append(discount * kinds / total)
        #: Letters never seen share the last order's rest evenly.
        self.floor = 1.0 / (1 << 16)

    def probability(self, packed: np.ndarray) -> np.ndarray:
        """Of the last letter of each window, after the others."""
        found = np.full(len(packed), self.floor)
        for k in range(1, ORDER + 1):
            gram = packed & np.uint64((1 << 16 * k) - 1 if k < ORDER else (1 << 64) - 1)
            at, seen = find(self.contexts[k - 1], gram >> np.uint64(16))
            rest = np.where(seen, self.rest[k - 1][at], 1.0)
            at, known = find(self.grams[k - 1], gram)
            found = rest * found + np.where(known, self.share[k - 1][at], 0.0)
        return found


def build(languages: list[str], counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model in one part."""
    return Model([part(languages, counted)], [None] * len(languages))


def part(languages: list[str], counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Part:
    lower = [Backoff(*counted[name]) for name in languages]
    every = np.unique(np.concatenate([counted[name][0] for name in languages]))
    hashes = mixed(every)
    order = np.argsort(hashes)
    hashes, every = hashes[order], every[order]
    costs = np.stack([np.log2(m.probability(every)) for m in lower], axis=1).astype(np.float32)
    begins = np.searchsorted(hashes >> np.uint64(64 - LEAD), np.arange((1 << LEAD) + 1, dtype=np.uint64)).astype(np.int32)
    return Part(languages, hashes, begins, costs, lower)


def cross_entropy(model: Model | Part, packed: np.ndarray) -> np.ndarray:
    """Bits per letter of a text under each language."""
    if isinstance(model, Model):
        return np.concatenate([cross_entropy(p, packed) for p in model.parts])
    asked = mixed(packed)
    # most windows are the first of those with their leading bits; the rest are searched for
    row = np.minimum(model.begins[(asked >> np.uint64(64 - LEAD)).astype(np.intp)], len(model.hashes) - 1)
    known = model.hashes[row] == asked
    other = np.flatnonzero(~known)
    row[other], known[other] = find(model.hashes, asked[other])
    if not known.all():
        row = row[known]
    bits = -(np.ones(len(row), np.float32) @ model.costs[row]).astype(np.float64)
    if len(row) < len(packed):
        unknown = packed[~known]
        bits = bits - np.array([np.log2(m.probability(unknown)).sum() for m in model.lower])
    return bits / len(packed)


def predict(model: Model, text: str | None) -> tuple[str, float, float | None, int]:
    """Language, score, bits per letter, number of letters."""
    found = symbols(text)
    letters = int((found != 32).sum())
    if not letters or not model.languages:
        return UNKNOWN, 0.0, None, letters
    packed = windows(found)
    return (*decide(model.languages, cross_entropy(model, packed), len(packed)), letters)


def decide(languages: list[str], bits: np.ndarray, size: int) -> tuple[str, float, float]:
    """The language of least bits per letter, of equal ones the first; its score and bits."""
    best = int(np.argmin(bits))
    # evidence grows with the square root of the length, as letters are not independent
    weights = np.exp(-(bits - bits[best]) * np.sqrt(size))
    return languages[best], float(1 / weights.sum()), float(bits[best])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", part_cells: int = PART_CELLS) -> Model:
    """A model from all given documents with a language; their ids are only hashed, to hold a tenth back.

    All windows are counted and kept. Languages go to a part, in order, as long as their
    windows times their number stay within `part_cells`. The held-back tenth calibrates the
    rejection. Null and empty texts and rows without a language teach nothing; texts are
    read whole, however long; an empty table gives a model without languages.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    held_back = remainder(doc_id, 10) == 7
    counts = scratch(window_counts(labelled.filter(~held_back), text, lang), "langid-counts")
    sizes = sorted((r.lang, r.n) for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect())
    model = Model([part(names, _counted(counts, names)) for names in _shares(sizes, part_cells)], [])
    if not sizes:
        return model
    held = noise_levels(labelled.filter(held_back), model, text, lang)
    middle = [*[F.percentile_approx(c, 0.5, 10000).alias(c) for c in ("bits", "noise")], F.count("*").alias("n")]
    medians = {r.lang: r for r in held.rollup("lang").agg(*middle).collect()}
    model.levels = [_level(medians.get(name), medians.get(None)) for name in model.languages]
    return model


def _shares(sizes: list[tuple[str, int]], part_cells: int) -> list[list[str]]:
    """The languages in order, in runs whose windows times their number stay within the bound."""
    runs: list[list[str]] = []
    total = 0
    for name, n in sizes:
        if not runs or (total + n) * (len(runs[-1]) + 1) > part_cells:
            runs.append([])
            total = 0
        runs[-1].append(name)
        total += n
    return runs


def _counted(counts: DataFrame, names: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    found = {}
    for name in names:
        table = counts.filter(F.col("lang") == name).select("gram", "n").toArrow()
        found[name] = (table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy())
    return found


def _level(own: Row | None, pooled: Row | None) -> tuple[float, float] | None:
    """A language's levels: its own, and those of all languages together, each by its number of held-back documents."""
    rows = [(r, n) for r, n in ((own, own.n if own else 0), (pooled, POOLED_WEIGHT)) if r is not None and n]
    if not rows:
        return None
    total = sum(n for _, n in rows)
    bits, noise = (sum(getattr(r, c) * n for r, n in rows) / total for c in ("bits", "noise"))
    return (bits, noise) if noise > bits else None


def noise_levels(docs: DataFrame, model: Model, text: str, lang: str) -> DataFrame:
    """(lang, bits, noise): bits per letter under the own language, of a text and of its letters shuffled.

    A round per part of the model; each takes the documents of its own languages.
    """

    def levels(sent, languages: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                rows = []
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = symbols(text)
                    if (found != 32).any():
                        mixed_up = np.random.default_rng(len(found)).permutation(found)
                        own = known.languages.index(name)
                        rows.append((name, *[float(cross_entropy(known, windows(x))[own]) for x in (found, mixed_up)]))
                kinds = (pa.string(), pa.float64(), pa.float64())
                arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "bits", "noise"])

        mine = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isin(languages))
        return mine.mapInArrow(run, "lang string, bits double, noise double")

    context = docs.sparkSession.sparkContext
    found = [levels(context.broadcast(p), p.languages) for p in model.parts]
    if len(found) > 1:  # one part after another is in memory
        found = [scratch(f, "langid-levels") for f in found]
    return reduce(DataFrame.unionAll, found)


def add_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds `lang_pred`, `score` (0 to 1), `cross_entropy` (bits per letter) and `letters`.

    Null, empty and letterless texts are `und` with score 0, also with an empty
    model. Ties go to the language that sorts first. Texts are read whole, however long.
    Columns of these names are replaced; rows come back as often as they are there; an
    empty table gives no rows.
    """
    if len(model.parts) > 1:
        return _by_parts(docs, model, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        known = sent.value

        def work(texts: list[str | None]) -> list[pa.Array]:
            found = [predict(known, t) for t in texts]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64())
            return [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]

        return work

    return add_from_text(docs, text, RESULT, compute)


def _by_parts(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """The same, one part of the model after another: bits per letter are kept by row, then put together."""
    added = [f.split()[0] for f in RESULT.split(", ")]
    kept = drop_clashing(docs, added)
    rows = scratch(kept.withColumn("__row", F.monotonically_increasing_id()), "langid-rows")
    bits = None
    for k, some in enumerate(model.parts):
        sent = docs.sparkSession.sparkContext.broadcast(some)

        def compute(sent=sent):
            def work(texts: list[str | None]) -> list[pa.Array]:
                packed = [windows(symbols(t)) for t in texts]
                found = [cross_entropy(sent.value, p).tolist() if len(p) else None for p in packed]
                letters = [int((symbols(t) != 32).sum()) for t in texts]
                return [pa.array(found, pa.list_(pa.float64())), pa.array([len(p) for p in packed]), pa.array(letters)]

            return work

        one = add_from_text(rows.select("__row", text), text, f"bits_{k} array<double>, size_{k} bigint, letters_{k} bigint", compute)
        one = scratch(one.drop(text), "langid-bits")
        bits = one if bits is None else bits.join(one.select("__row", f"bits_{k}"), "__row")
    languages = model.languages

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for per_language, size, letters in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                known = letters and per_language
                found.append((*decide(languages, np.array(per_language), size), letters) if known else (UNKNOWN, 0.0, None, letters))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64())
            arrays = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["__row", *added])

    every = F.concat(*[F.col(f"bits_{k}") for k in range(len(model.parts))])
    chosen = bits.select("__row", every.alias("bits"), "size_0", "letters_0").mapInArrow(choose, f"__row bigint, {RESULT}")
    return rows.join(chosen, "__row").drop("__row")


def rejected(model: Model) -> Column:
    """Whether a row of `add_language` is rejected: no letters, or nearer to noise than to its language.

    Where nothing was held back to tell by, what costs more than even letters is noise.
    """
    limits = []
    for name, level in zip(model.languages, model.levels):
        own, noise = level or (model.ceiling, model.ceiling)
        limits.append(F.struct(F.lit(name).alias("lang"), F.lit(own).alias("own"), F.lit(noise).alias("noise")))
    mine = F.get(F.filter(F.array(*limits), lambda x: x["lang"] == F.col("lang_pred")), F.lit(0)) if limits else None
    if mine is None:
        return F.lit(True)

    def limit(x: Column) -> Column:
        return (x["own"] + x["noise"]) / 2 + 2 * (x["noise"] - x["own"]) / F.sqrt(F.greatest(F.col("letters"), F.lit(1)))

    return (F.col("lang_pred") == UNKNOWN) | F.coalesce(F.col("cross_entropy") > limit(mine), F.lit(True))


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents a model may learn from."""
    return docs.filter(remainder(doc_id, 3) != 1)


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The documents in a language the model knows, as they came; the others are rejected.

    With no document to learn from, nothing can be told apart and all stay.
    """
    model = train(training_rows(docs, doc_id), text, lang, doc_id)
    if not model.languages:
        return docs
    found = add_language(docs.withColumn("__row", F.struct("*")), model, text)
    return found.filter(~rejected(model)).select("__row.*")

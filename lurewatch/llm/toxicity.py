"""Toxicity: a weighted lexicon, found by one Aho-Corasick automaton in folded text.

Folding lowers letters, drops accents and marks, and maps look-alike letters and
digits used as letters to one skeleton, in the lexicon as in the text. Entries are
whole words or beginnings of words; words within an exception phrase do not count.
Weights are learned from labelled documents: the log of how much more often toxic
ones hold an entry. The sum of weights, taken by length, gives a calibrated score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.llm.common import add_from_text, once, scratch, slices
from lurewatch.llm.labelled import labelled_sample
from lurewatch.llm.quality import sigmoid

#: Rows a lexicon is learned from and calibrated on, at most about this many: a bounded sample by a hash of the id.
MAX_ROWS = 30_000
STEMS = (4, 5, 6)
#: An entry occurs in so many toxic documents of the sample at least.
LEAST_DOCUMENTS = 4
LEAST_WEIGHT = 1.5
#: Share of the entries that may be there by chance: sets how much evidence an entry needs, by how many were tested.
CHANCE = 0.03
#: Parts of the sample; each is measured for the calibration with a lexicon of the others.
FOLDS = 8
#: A beginning of words says nothing of its own if one word makes up this share of it.
ONE_WORD = 0.8

#: Letters of other scripts that look like Latin ones, and signs and digits written for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w", "ь": "b", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ɑ": "a", "ɡ": "g", "ʟ": "l",
}
INSTEAD = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Phrases in which a word of a lexicon means no harm.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "take out the trash", "taking out the trash",
    "pond scum", "soap scum", "clown fish", "circus clown", "class clown", "party clown", "sore loser", "loser bracket",
    "worthless check", "pathetic fallacy", "stupid question", "no such thing as a stupid question",
)


def _folding() -> np.ndarray:
    """Symbol of every code point: 32 for what separates words, 0 for what is dropped."""
    table = np.full(0x110000, 32, np.uint16)
    for code in range(0x110000):
        sign = chr(code)
        if sign in INSTEAD:
            table[code] = ord(INSTEAD[sign])
        elif sign.isalpha() or sign.isdigit():
            low = LOOK_ALIKE.get(sign.lower()) or unicodedata.normalize("NFKD", sign.lower())[0]
            low = INSTEAD.get(low) or LOOK_ALIKE.get(low) or low
            # 1 stands for i as well as for l
            low = "i" if low == "l" else low
            table[code] = ord(low) if ord(low) < 0xD800 else 0xE000 + (code >> 8 & 0xFFF)
        elif unicodedata.category(sign) in ("Mn", "Me", "Cf"):
            table[code] = 0
    return table


def fold(text: str | None) -> str:
    """The words of a text as skeletons, each between single spaces; a single space if there are none."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    found = once("folding", 0, _folding)[codes]
    found = np.concatenate(([32], found[found > 0], [32])).astype("<u2")
    twice = np.zeros(len(found), bool)
    twice[1:] = (found[1:] == 32) & (found[:-1] == 32)
    return found[~twice].tobytes().decode("utf-16-le")


@dataclass
class Lexicon:
    #: Skeleton of a word, with a star for a beginning of words, and its weight.
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    #: Intercept and slopes of the calibration; None without labels to calibrate on.
    calibration: tuple[float, float, float] | None


def automaton(lexicon: Lexicon) -> ahocorasick.Automaton | None:
    built = ahocorasick.Automaton()
    for place, (entry, weight) in enumerate(lexicon.weights.items()):
        key = " " + entry[:-1] if entry.endswith("*") else f" {entry} "
        built.add_word(key, (len(key), weight, place))
    for phrase in lexicon.exceptions:
        key = fold(phrase)
        if key.strip():
            built.add_word(key, (len(key), None, -1))
    if not len(built):
        return None
    built.make_automaton()
    return built


def measure(built: ahocorasick.Automaton | None, text: str | None) -> tuple[float, int]:
    """Sum of the weights found, and the number of words.

    A word counts for the weightiest entry that it is or begins with; an entry that
    recurs adds its weight times the logarithm of its number.
    """
    line = fold(text)
    words = line.count(" ") - 1
    if built is None or words < 1:
        return 0.0, max(words, 0)
    best: dict[int, tuple[float, int]] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight, place) in built.iter(line):
        begin = end - size + 1
        if weight is None:
            spared.append((begin, end))
        elif (weight, place) > best.get(begin, (0.0, -1)):
            best[begin] = weight, place
    for begin, end in spared:
        for at in [a for a in best if begin <= a < end]:
            del best[at]
    return sum(weight * (1 + np.log(n)) for (weight, _), n in Counter(best.values()).items()), words


def inputs(total: float, words: int) -> tuple[float, float]:
    """What the calibration sees: the weight in all, and by length."""
    return float(np.log1p(total)), float(np.log1p(100 * total / max(words, 1)))


def score(lexicon: Lexicon, built: ahocorasick.Automaton | None, text: str | None) -> float:
    if lexicon.calibration is None:
        return 0.0
    a, b, c = lexicon.calibration
    x, y = inputs(*measure(built, text))
    return sigmoid(a + b * x + c * y)


# --- learning -----------------------------------------------------------------


def entries_of(text: str | None) -> set[str]:
    words = set(fold(text).split())
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def entry_counts(sample: DataFrame) -> DataFrame:
    """(entry, toxic_0, clean_0, toxic_1, ...): in how many documents of each label and fold an entry occurs, summed per task first."""
    names = [f"{kind}_{fold}" for fold in range(FOLDS) for kind in ("toxic", "clean")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = [Counter() for _ in names]
            for label, fold, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts[2 * fold + 1 - label].update(entries_of(text))
            found = list(set().union(*counts))
            arrays = [pa.array(found, pa.string()), *[pa.array([c[e] for e in found], pa.int64()) for c in counts]]
            yield pa.RecordBatch.from_arrays(arrays, names=["entry", *names])

    fields = ", ".join(["entry string", *[f"{n} bigint" for n in names]])
    counted = sample.select("label", "fold", "text").mapInArrow(run, fields)
    return counted.groupBy("entry").agg(*[F.sum(n).alias(n) for n in names])


def evidence(toxic: int, clean: int, share: float) -> float:
    """Log-likelihood ratio of an entry against one that does not depend on the label; `share` of documents are toxic."""
    both = toxic + clean
    return 2 * sum(n * math.log(n / (both * s)) for n, s in ((toxic, share), (clean, 1 - share)) if n)


def select(counts: dict[str, tuple[int, int]], tested: int, toxic: int, clean: int) -> dict[str, float]:
    """The entries and their weights: as many as keep the share that is there by chance (Benjamini and Hochberg).

    counts: documents of each label that hold an entry; tested: how many entries were looked at.
    """
    if not toxic or not clean:
        return {}
    found = []
    for entry, (n, other) in counts.items():
        weight = math.log((n + 0.5) / (toxic + 1)) - math.log((other + 0.5) / (clean + 1))
        if n >= LEAST_DOCUMENTS and weight > 0:
            found.append((evidence(n, other, toxic / (toxic + clean)), entry, weight, n))
    found.sort(key=lambda x: (-x[0], x[1]))
    kept = max((k for k, x in enumerate(found, 1) if by_chance(x[0]) * tested <= CHANCE * k), default=0)
    return without_single_words({e: (w, n) for _, e, w, n in found[:kept] if w >= LEAST_WEIGHT})


def by_chance(ratio: float) -> float:
    """How likely so much evidence is without any dependence."""
    return math.erfc(math.sqrt(max(ratio, 0.0) / 2))


def fit(rows: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Logistic regression of the label on both inputs, by Newton's method with a little shrinkage.

    More weight never lowers a score: an input whose slope would be negative is left out.
    """
    x = np.array([(1.0, a, b) for a, b, _ in rows])
    y = np.array([label for *_, label in rows], float)
    for used in ([0, 1, 2], [0, 1], [0, 2], [0]):
        some, found = x[:, used], np.zeros(len(used))
        shrink = np.diag([(1e-3, 0.1, 0.1)[i] for i in used])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(some @ found, -35, 35)))
            found += np.linalg.solve((some * (p * (1 - p))[:, None]).T @ some + shrink, some.T @ (y - p) - shrink @ found)
        if (found[1:] >= 0).all():
            break
    weights = np.zeros(3)
    weights[used] = found
    return tuple(float(w) for w in weights)


def without_single_words(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """The weights of the entries, without beginnings that owe their count to one word that is an entry itself."""
    most: dict[str, int] = {}
    for entry, (_, count) in found.items():
        for n in STEMS if not entry.endswith("*") else ():
            most[entry[:n] + "*"] = max(count, most.get(entry[:n] + "*", 0))
    return {e: w for e, (w, count) in found.items() if most.get(e, 0) < ONE_WORD * count}


def learn(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, max_rows: int = MAX_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS
) -> Lexicon:
    """A lexicon from labelled documents that `allowed` lets in (a condition on doc_id).

    The whole sample gives the entries. The calibration sees each document as it is
    measured by a lexicon of the other folds. Without labelled rows the lexicon is empty
    and every score is 0; with rows of one label only it has no entries. Null and empty
    texts teach that nothing is in them; texts are read whole, however long.
    """
    sample = labelled_sample(docs, labels, label, allowed, max_rows)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int"))
    n = {(r.fold, r.label): r.n for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([[n.get((fold, kind), 0) for kind in (1, 0)] for fold in range(FOLDS)])
    toxic, clean = sizes.sum(axis=0).tolist()
    counts: dict[str, np.ndarray] = {}
    tested = 0
    if toxic and clean:
        sums = [sum((F.col(f"{kind}_{fold}") for fold in range(FOLDS)), F.lit(0)) for kind in ("toxic", "clean")]
        both = sums[0] + sums[1]
        expected = both * toxic / (toxic + clean)
        ratio = 2 * (
            sums[0] * F.log(sums[0] / expected)
            + F.when(sums[1] > 0, sums[1] * F.log(sums[1] / (both - expected))).otherwise(0.0)
        )
        often = scratch(entry_counts(sample).filter(sums[0] >= LEAST_DOCUMENTS).withColumn("ratio", ratio), "toxicity-entries")
        tested = often.count()
        # no more can be chosen than have evidence for one; the sample bounds their number
        likely = often.filter((sums[0] > expected) & (F.col("ratio") >= least_evidence()))
        counts = {r[0]: np.array(r[1:-1], np.int64).reshape(FOLDS, 2) for r in likely.collect()}
    whole = {e: c.sum(axis=0) for e, c in counts.items()}
    lexicon = Lexicon(select({e: tuple(c.tolist()) for e, c in whole.items()}, tested, toxic, clean), exceptions, None)
    parts = []
    for fold in range(FOLDS):
        rest = {e: tuple((whole[e] - c[fold]).tolist()) for e, c in counts.items()}
        left = (np.array([toxic, clean]) - sizes[fold]).tolist()
        parts.append(Lexicon(select(rest, tested, *left), exceptions, None))
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = [automaton(x) for x in sent.value]
        for batch in slices(batches):
            rows = [inputs(*measure(built[fold], t)) for fold, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            arrays = [pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(0)], names=["a", "b", "label"])

    seen = sample.select("label", "fold", "text").mapInArrow(run, "a double, b double, label int")
    rows = sorted((r.a, r.b, r.label) for r in seen.collect())
    if rows:
        lexicon.calibration = fit(rows)
    return lexicon


def least_evidence() -> float:
    """Evidence that is there by chance in a share CHANCE of all entries: what any chosen one has at least."""
    low, high = 0.0, 100.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if by_chance(middle) > CHANCE else (low, middle)
    return low


def add_score(docs: DataFrame, lexicon: Lexicon, text: str = "text", output: str = "score") -> DataFrame:
    """Adds the probability that a text is toxic.

    Null, empty and wordless texts have the score of a text without any entry. Texts are
    read whole, however long. Of entries that begin at the same place the weightiest counts, of
    equal ones the later in the lexicon. A column of the same name is replaced; rows come
    back as often as they are there; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def compute():
        built = automaton(sent.value)
        return lambda texts: [pa.array([score(sent.value, built, t) for t in texts], pa.float64())]

    return add_from_text(docs, text, f"`{output}` double", compute)

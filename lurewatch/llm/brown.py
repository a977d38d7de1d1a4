"""Language-model scores by Brown's class-based bigrams.

Words of the training documents are counted by Spark; every word seen twice gets a
class by exchange, that where the bigram likelihood is greatest. The most frequent
ones are exchanged one after another until none moves. The others move at once, half
of them in turn: which words stand before and after each of them is counted once, dealt
out by words, and kept in packed blocks. A pass reads the blocks beside the classes,
without an exchange of rows, and hands back the words that move. A pass that lowers the
likelihood is taken back. Words seen once, and unknown ones, form one class of rare
words. A text's probability is the product of class transitions and of words given
their class.

Texts are cut into words twice: to count them, and to store their places in the
vocabulary, which all else reads. Tasks hold a hash, a count and a class of each word
seen twice; counts of rare words are joined to the documents that hold them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.llm.common import few_rows, forget, once, scratch, slices
from lurewatch.llm.pieces import TOGETHER, PieceTable
from lurewatch.llm.simhash import LOWER

#: The end of a text, as a token; no word holds white space.
END = "\n"
#: Words that are exchanged one after another, the most frequent ones; the others follow them.
EXCHANGED = 1024
#: Classes, at least; they grow with the square root of the number of words.
CLASSES = 64
PASSES = 6
#: Passes over the other words end when fewer than this share of them move.
SETTLED = 0.01
#: Weight of the class's own frequency in a transition.
SMOOTH = 5.0
HELD = 300_000
#: Words handed on at once.
PART = 1 << 15
#: Tokens and table cells that are worked on at once; neighbours of words in a block, about.
AT_ONCE = 1 << 21
BLOCK = 1 << 18
#: Counts up to this have their steps in the likelihood looked up.
LOOKED_UP = 16
#: Tables of more classes keep these steps in single precision.
SINGLE = 32
#: Fewer rows than this are added up one by one.
FEW_ROWS = 16


def tokens(text: str | None) -> list[str]:
    """Lower-case words and the end."""
    return [*spaced(text).decode("utf-8", "surrogatepass").split(" ")[1:], END]


def spaced(text: str | None) -> bytes:
    """The lower-case words, each after one space."""
    # bytes divide at ASCII white space only
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return b" " + b" ".join(words) if words else b""


def _groups(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Spaced texts in groups of bounded length, one text at least."""
    some, held = [], 0
    for text in texts:
        some.append(spaced(text))
        held += len(some[-1])
        if held >= TOGETHER:
            yield some
            some, held = [], 0
    if some:
        yield some


def _looked_up(table: PieceTable, texts: list[bytes]) -> list[np.ndarray]:
    """Of each spaced text what the table has for its words; a word goes with its space."""
    raw = b"".join(texts)
    starts = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    return table.look_up(raw, starts, np.searchsorted(starts, np.cumsum([0, *map(len, texts)])))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; a task adds up its own first, HELD words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        table = PieceTable(lambda new: [[held.setdefault(w, len(held))] for w in new])
        counts, ends = np.zeros(0, np.int64), 0

        def rows() -> Iterator[pa.RecordBatch]:
            words = iter(held)
            for at in range(0, len(held), PART):
                some = pa.array([w[1:].decode() for w in islice(words, PART)], pa.string())
                yield pa.RecordBatch.from_arrays([some, pa.array(counts[at : at + PART])], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends])], names=["word", "n"])

        for batch in slices(batches):
            for some in _groups(batch.column(0).to_pylist()):
                found = np.concatenate(_looked_up(table, some))
                more = np.bincount(found, minlength=len(held))
                more[: len(counts)] += counts
                counts, ends = more, ends + len(some)
                if len(held) > HELD:
                    yield from rows()
                    held.clear()
                    table.clear()
                    counts, ends = np.zeros(0, np.int64), 0
        if ends:
            yield from rows()

    return docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The words seen twice by falling count, the end first: their hashes and counts; sums over all words."""

    hashes: np.ndarray
    counts: np.ndarray
    #: Tokens and distinct tokens of the training documents.
    total: int
    distinct: int

    @property
    def key(self) -> str:
        return f"{self.total}-{self.distinct}-{xxhash.xxh64_hexdigest(self.hashes.tobytes())}"


def vocabulary(counts: DataFrame) -> Vocabulary:
    """All words that occur at least twice, and the end."""
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    # words that occur once are rare: they tell how likely an unknown word is
    named = counts.filter((F.col("n") >= 2) | (F.col("word") == END))
    table = named.select(F.xxhash64("word").alias("hash"), "n").toArrow()
    hashes, numbers = table["hash"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.lexsort((hashes, -numbers, hashes != hash_of(END)))
    return Vocabulary(hashes[order], numbers[order], int(sums.total or 0), int(sums.distinct))


def hash_of(word: str) -> int:
    """As Spark's xxhash64."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


class Index:
    """Places of words in the vocabulary, -1 for rare ones."""

    def __init__(self, known: Vocabulary):
        self.order = np.argsort(known.hashes)
        self.sorted = known.hashes[self.order]
        self.table = PieceTable(self._places)

    def of(self, words: list[str]) -> np.ndarray:
        return self._of([w.encode("utf-8", "surrogatepass") for w in words])

    def _of(self, words: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w, 42) for w in words), np.uint64, len(words))
        if not len(self.sorted):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)

    def _places(self, words: list[bytes]) -> list[list[int]]:
        # as unsigned numbers of 32 bits
        return [[p & 0xFFFFFFFF] for p in self._of([w[1:] for w in words]).tolist()]

    def of_texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Places of each `spaced` text's words, and of the end."""
        end = self.of([END]).astype(np.int32)
        return [np.concatenate((x.view(np.int32), end)) for x in _looked_up(self.table, texts)]


def _index(known: Vocabulary) -> Index:
    return once("vocabulary", known.key, lambda: Index(known))


ENCODED = "doc_id bigint, taught boolean, ids array<int>, rare_words array<string>, rare_counts array<bigint>"


def encoded(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """(doc_id, taught, text) with the text as `ids`, places of its words, and its rare words; written once, read by all else."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(sent.value)
        for batch in slices(batches):
            at = 0
            for some in _groups(batch.column(2).to_pylist()):
                found = index.of_texts(some)
                rare = [_rare(text, ids) for text, ids in zip(some, found)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                columns = [
                    batch.column(0).slice(at, len(some)), batch.column(1).slice(at, len(some)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))),
                    pa.array([list(r) for r in rare], pa.list_(pa.string())), pa.array([list(r.values()) for r in rare], pa.list_(pa.int64())),
                ]
                at += len(some)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "taught", "ids", "rare_words", "rare_counts"])

    return scratch(docs.select("doc_id", "taught", "text").mapInArrow(run, ENCODED), "brown-ids")


def _rare(text: bytes, ids: np.ndarray) -> Counter:
    places = np.flatnonzero(ids[:-1] < 0).tolist()
    if not places:
        return Counter()
    words = text.split(b" ")
    return Counter(words[i + 1].decode() for i in places)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The ids of a task's texts one after another, some at a time; a text begins after an end."""
    last = np.zeros(1, np.int64)
    for batch in slices(batches):
        ids = batch.column(0).flatten().to_numpy()
        for at in range(0, len(ids), AT_ONCE):
            held = np.concatenate((last, ids[at : at + AT_ONCE]))
            yield held
            last = held[-1:]


def transitions(ids: DataFrame, places: np.ndarray, size: int) -> np.ndarray:
    """How often one class follows another, as a matrix; places: of each word its class, at last that of rare words."""
    sent = ids.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("vocabulary")
        total = np.zeros(size * size, np.int64)
        for some in _streams(batches):
            total += _pairs(sent.value[some], size)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    return _matrix(ids.select("ids").mapInArrow(run, "cell bigint, n bigint"), size)


def _pairs(symbols: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(symbols[:-1] * size + symbols[1:], minlength=size * size)


def exchange(pairs: np.ndarray, own: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each symbol: the first `own` are exchanged among `classes`, the others keep one each."""
    size = len(pairs)
    classes = min(classes, own)
    total = classes + size - own
    of = np.concatenate((np.arange(own) % max(classes, 1), classes + np.arange(size - own)))
    member = np.zeros((size, total))
    member[np.arange(size), of] = 1
    table = member.T @ pairs @ member

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(passes):
        moved = 0
        for w in range(own):
            after = pairs[w] @ member
            before = pairs[:, w] @ member
            self_ = pairs[w, w]
            old = of[w]
            after[old] -= self_
            before[old] -= self_
            # the table without the word
            table[old] -= after
            table[:, old] -= before
            table[old, old] -= self_
            # gain of adding it to each class: its row, its column, where they cross, and the class's own frequency
            rows = f(table[:classes] + after) - f(table[:classes])
            columns = f(table[:, :classes].T + before) - f(table[:, :classes].T)
            own_cell = np.arange(classes)
            cross = table[own_cell, own_cell]
            gain = rows.sum(axis=1) + columns.sum(axis=1) - rows[own_cell, own_cell] - columns[own_cell, own_cell]
            gain += f(cross + after[:classes] + before[:classes] + self_) - f(cross)
            # what other words say before and after the word counts for their classes wherever it goes
            left = table.sum(axis=1)[:classes] + before[:classes]
            right = table.sum(axis=0)[:classes] + after[:classes]
            gain -= f(left + after.sum() + self_) - f(left) + f(right + before.sum() + self_) - f(right)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-6:
                new = old
            moved += new != old
            table[new] += after
            table[:, new] += before
            table[new, new] += self_
            member[w, old], member[w, new] = 0, 1
            of[w] = new
        if not moved:
            break
    return of


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _add_rows(found: np.ndarray, row: np.ndarray, values: Callable[[np.ndarray], np.ndarray]) -> None:
    """Adds to each row of `found` the values of its entries; row: of each entry, ascending.

    First one entry of every row, then the next of those that have more, so that whole tables are added.
    """
    first = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(first, append=len(row))
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    for k in range(int(count[0]) if len(count) else 0):
        more = int(np.searchsorted(-count, -k))
        if more < FEW_ROWS:
            # what is left of the longest rows
            for at, n in zip(first[:more].tolist(), count[:more].tolist()):
                found[row[at]] += values(np.arange(at + k, at + n)).sum(axis=0)
            break
        found[row[first[:more]]] += values(first[:more] + k)


class Steps:
    """What adding 1, 2, ... to each cell of a table gives: computed once, used for every word."""

    def __init__(self, table: np.ndarray):
        self.table, own = table, len(table) - 1
        more = np.arange(1, LOOKED_UP + 1)[:, None, None]
        # rows: direction, count, other class; columns: the class a word may join
        self.bases = [_f(cells[:own].T) for cells in (table, table.T)]
        sides = [_f(cells[:own].T + more) - base for cells, base in zip((table, table.T), self.bases)]
        self.steps = np.concatenate([x.reshape(-1, own) for x in sides])
        if len(table) > SINGLE:
            self.steps = self.steps.astype(np.float32)

    def summed(self, side: int, row: np.ndarray, d: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
        """For each word (a row) the sum over its cells, per class it may join; of a cell: the word, the other class, how often."""
        found = np.zeros((rows, len(self.table) - 1), self.steps.dtype)
        _add_rows(found, row, lambda entry: self.of(side, n[entry], d[entry]))
        return found

    def of(self, side: int, n: np.ndarray, other: np.ndarray) -> np.ndarray:
        """One row per count and other class."""
        size = len(self.table)
        few = np.minimum(n, LOOKED_UP).astype(np.int64)
        found = self.steps[(side * LOOKED_UP + few - 1) * size + other]
        many = np.flatnonzero(n > LOOKED_UP)
        if len(many):
            base = (self.table, self.table.T)[side][:-1, other[many]].T
            found[many] = _f(base + n[many, None]) - self.bases[side][other[many]]
        return found


def _cells(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of what is not zero."""
    # of truth values they are found several times as fast as of numbers
    row, column = np.nonzero(counts != 0)
    return row, column, counts[row, column]


def gains(
    after: np.ndarray, before: np.ndarray, self_: np.ndarray, old: np.ndarray, table: np.ndarray, steps: Steps | None = None
) -> np.ndarray:
    """What likelihood each word (a row) gives to each class it may join, taken out of its old one.

    after, before: how often classes stand next to it, itself left out; self_: how
    often it follows itself; table: class transitions, the last class is that of rare words.
    Most words stand beside few classes: only the mass of a word goes to all of its row.
    """
    steps = steps or Steps(table)
    own, rows = len(table) - 1, np.arange(len(old))
    sides = [(*_cells(counts), counts, cells) for counts, cells in ((after, table), (before, table.T))]
    gain = np.zeros((len(old), own))
    for side, (row, c, n, _, _) in enumerate(sides):
        gain += steps.summed(side, row, c, n, len(old))
    # the table still holds the word: in the old class's column and row other words' counts are too high
    for (_, _, _, counts, cells), (row, c, gone, _, _) in (sides, sides[::-1]):
        held = counts[rows, old]
        some = (held[row] > 0) & (c < own)
        row, c, gone = row[some], c[some], gone[some]
        n, cell = held[row], cells[c, old[row]]
        gain[row, c] += _f(cell - gone + n) - _f(cell - gone) - _f(cell + n) + _f(cell)
    # a class beside itself: both sides and the word's own pairs go to one cell
    diagonal = np.diag(table)[:own]
    row, c, x = sides[0][:3]
    y = before[row, c]
    both = (y > 0) & (c < own) & (self_[row] == 0)
    double = np.flatnonzero(self_ > 0)
    row, c = (np.concatenate(p) for p in ((row[both], np.repeat(double, own)), (c[both], np.tile(np.arange(own), len(double)))))
    x, y = (np.concatenate((found[both], counts[double, :own].ravel())) for found, counts in ((x, after), (y, before)))
    cell = diagonal[c]
    gain[row, c] += _f(cell + x + y + self_[row]) - _f(cell + x) - _f(cell + y) + _f(cell)
    masses = [np.bincount(row, n, len(old)) + self_ for row, _, n, _, _ in sides]
    totals = table.sum(axis=1), table.sum(axis=0)
    for mass, sums in zip(masses, totals):
        # few words have a mass of their own
        some = np.sort(mass)
        some = some[np.flatnonzero(np.diff(some, prepend=-1))]
        gain -= (_f(sums[:own] + some[:, None]) - _f(sums[:own]))[np.searchsorted(some, mass)]
    # staying: the old class's cells with the word against those without it
    inside = rows[old < own]
    if len(inside):
        mine, stay = old[inside], np.zeros(len(old))
        for (row, d, n, _, cells), mass, sums in zip(sides, masses, totals):
            apart = (d != old[row]) & (old[row] < own)
            row, d, n = row[apart], d[apart], n[apart]
            cell = cells[old[row], d]
            stay += np.bincount(row, _f(cell) - _f(cell - n), len(old))
            stay[inside] -= _f(sums[mine]) - _f(sums[mine] - mass[inside])
        cell = np.diag(table)[mine]
        gain[inside, mine] = stay[inside] + _f(cell) - _f(cell - after[inside, mine] - before[inside, mine] - self_[inside])
    return gain


def likelihood(table: np.ndarray) -> float:
    """Of the transitions, as far as it depends on the classes."""
    return float(_f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum())


def better(word: np.ndarray, cell: np.ndarray, n: np.ndarray, of: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """The words that move, and where to. A word's cells: classes after it, classes before it, itself."""
    table = steps.table
    size, own = len(table), len(table) - 1
    width = 2 * size + 1
    if (np.diff(word) < 0).any():
        order = np.argsort(word, kind="stable")
        word, cell, n = word[order], cell[order], n[order]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    ids = word[first].astype(np.int64)
    ends = np.append(first[1:], len(word))
    moved, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, AT_ONCE // (4 * size))
    for at in range(0, len(ids), step):
        end = min(at + step, len(ids))
        part = slice(first[at], ends[end - 1])
        # counts of a cell add up where they are put, without sorting
        row = np.repeat(np.arange(end - at), ends[at:end] - first[at:end])
        table_of = np.bincount(row * width + cell[part], n[part], (end - at) * width).reshape(end - at, width)
        old = of[ids[at:end]].astype(np.int64)
        gain = gains(table_of[:, :size], table_of[:, size : 2 * size], table_of[:, 2 * size], old, table, steps)
        new = np.argmax(gain, axis=1)
        row = np.arange(end - at)
        moves = (old == own) | (gain[row, new] > gain[row, np.minimum(old, own - 1)] + 1e-6)
        moved.append(ids[at:end][moves])
        to.append(new[moves])
    return np.concatenate(moved), np.concatenate(to)


def neighbours(ids: DataFrame, fixed: int, words: int, tokens: int) -> DataFrame:
    """What stands beside each word from `fixed` on, in blocks (keys, n): counted once, sorted by word.

    A key is (word * (words + 1) + other) * 2, and one more where the other stands before; the
    place of rare words is `words`. A task adds up its own pairs first and packs them by the
    remainder of the word, so that few rows are dealt out and no range is hot.
    """
    ranges = max(1, -(-tokens // AT_ONCE) * 4)

    def packed(keys: np.ndarray, n: np.ndarray, number: int) -> pa.RecordBatch:
        deltas = np.diff(keys, prepend=0)
        columns = [pa.array([number], pa.int32()), pa.array([deltas.tobytes()], pa.binary()), pa.array([n.astype(np.int32).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["range", "keys", "n"])

    def summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        all_keys = np.concatenate(keys)
        order = np.argsort(all_keys, kind="stable")
        all_keys = all_keys[order]
        first = np.flatnonzero(np.diff(all_keys, prepend=-1))
        return all_keys[first], np.add.reduceat(np.concatenate(n)[order], first, dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("vocabulary")
        held: list[np.ndarray] = []

        def dealt() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([np.zeros(0, np.int64), *held])
            held.clear()
            # sorted in place, equal ones beside each other: nothing else as long is made
            keys.sort()
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            n = np.diff(first, append=len(keys))
            keys = keys[first]
            part = keys // (2 * (words + 1)) % ranges
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(ranges + 1))
            for r in range(ranges):
                some = order[bounds[r] : bounds[r + 1]]
                if len(some):
                    yield packed(keys[some], n[some], r)

        for some in _streams(batches):
            some = np.where(some < 0, words, some).astype(np.int64)
            left, right = some[:-1], some[1:]
            for word, other, side in ((left, right, 0), (right, left, 1)):
                # a word beside itself counts once
                mine = (word >= fixed) & (word < words) & ((side == 0) | (word != other))
                held.append((word[mine] * (words + 1) + other[mine]) * 2 + side)
            if sum(map(len, held)) > AT_ONCE:
                yield from dealt()
        yield from dealt()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers, current = [], [], None

        def blocks() -> Iterator[pa.RecordBatch]:
            keys, n = summed(held, numbers)
            word = keys // (2 * (words + 1))
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            # a block ends where a word does
            cuts = [0]
            while cuts[-1] < len(keys):
                later = starts[np.searchsorted(starts, cuts[-1] + BLOCK) :]
                cuts.append(int(later[0]) if len(later) else len(keys))
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield packed(keys[a:b], n[a:b], current)

        for batch in batches:
            for number, keys, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if number != current and held:
                    yield from blocks()
                    held, numbers = [], []
                current = number
                held.append(np.cumsum(np.frombuffer(keys.as_buffer(), np.int64)))
                numbers.append(np.frombuffer(n.as_buffer(), np.int32))
        if held:
            yield from blocks()

    fields = "range int, keys binary, n binary"
    rows = ids.select("ids").mapInArrow(count, fields).repartition(ranges, "range").sortWithinPartitions("range")
    return scratch(rows.mapInArrow(merge, fields).select("keys", "n"), "brown-neighbours")


def _unpacked(keys: pa.Scalar, n: pa.Scalar, words: int) -> tuple[np.ndarray, ...]:
    """A block's words, what stands beside them, whether it stands before, and how often."""
    keys = np.cumsum(np.frombuffer(keys.as_buffer(), np.int64))
    n = np.frombuffer(n.as_buffer(), np.int32)
    pair = keys >> 1
    word = pair // (words + 1)
    return word, pair - word * (words + 1), keys & 1, n


def moved_transitions(beside: DataFrame, of: np.ndarray, fixed: int, size: int) -> np.ndarray:
    """The transitions that a word from `fixed` on takes part in, from the blocks of its neighbours."""
    sent, words = beside.sparkSession.sparkContext.broadcast(of), len(of) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = sent.value, np.zeros(size * size)
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1)):
                word, other, side, n = _unpacked(keys, n, words)
                first = side == 0
                total += np.bincount(of[word[first]] * size + of[other[first]], n[first], size * size)
                # of two words that both move the first one has the pair
                last = ~first & ((other < fixed) | (other == words))
                total += np.bincount(of[other[last]] * size + of[word[last]], n[last], size * size)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells].astype(np.int64))], names=["cell", "n"])

    return _matrix(beside.mapInArrow(run, "cell bigint, n bigint"), size)


def _matrix(cells: DataFrame, size: int) -> np.ndarray:
    counted = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(size * size)
    matrix[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return matrix.reshape(size, size)


def follow(
    ids: DataFrame, of: np.ndarray, fixed: int, tokens: int, passes: int = PASSES, apart: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words by exchange, the first `fixed` staying where they are, at last that of rare words; and the transitions.

    `apart`: the transitions with the words from `fixed` on as a class of their own after that of rare words, if they are known.

    The others come from the class of rare words. In the first pass all of them get a
    class; later ones let every second word move, so that words of a kind do not swap
    places, and count only if the likelihood rises.
    """
    spark, size, of = ids.sparkSession, int(of[-1]) + 1, of.copy()
    words = len(of) - 1
    if apart is None:
        apart = transitions(ids, np.concatenate((of[:fixed], np.full(words - fixed, size), of[-1:])).astype(of.dtype), size + 1)
    staying = apart[:size, :size]
    table = folded(apart, np.minimum(np.arange(size + 1), size - 1))
    if words <= fixed or size < 2:
        return of, table
    beside = neighbours(ids, fixed, words, tokens)
    share = 1.0
    for turn in range(passes):
        sent = spark.sparkContext.broadcast((of, table))

        def move(batches: Iterator[pa.RecordBatch], turn: int = turn, sent=sent) -> Iterator[pa.RecordBatch]:
            of, table = sent.value
            steps = Steps(table)
            for batch in batches:
                for keys, n in zip(batch.column(0), batch.column(1)):
                    word, other, side, n = _unpacked(keys, n, words)
                    if turn:
                        mine = (word // 2 + turn) % 2 == 0
                        word, other, side, n = word[mine], other[mine], side[mine], n[mine]
                    cell = np.where(word == other, 2 * size, of[other] + size * side)
                    found = better(word, cell, n, of, steps)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["word", "to"])

        found = beside.mapInArrow(move, "word bigint, to bigint").toArrow()
        new = of.copy()
        new[found["word"].to_numpy()] = found["to"].to_numpy()
        after = staying + moved_transitions(beside, new, fixed, size)
        if turn and likelihood(after) <= likelihood(table):
            break
        of, table = new, after
        moved = found.num_rows / (words - fixed)
        # the halves of two passes together are all words
        if turn > 1 and moved + share < SETTLED:
            break
        share = moved
    return of, table


@dataclass
class Model:
    known: Vocabulary
    #: log10 probabilities: of a class after a class, of each known word in its class.
    after: np.ndarray
    emitted: np.ndarray
    #: Class of each known word, then of rare words.
    classes: np.ndarray
    #: Tokens of rare words, one more for each kind, and one for all that are unknown.
    rare: int


def train(docs: DataFrame, counts: DataFrame, text: str = "text") -> Model:
    """A model of the documents and their word counts."""
    known = vocabulary(counts)
    named = docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(True).alias("taught"), F.col(text).alias("text"))
    return learn(known, encoded(named, known))


def learn(known: Vocabulary, ids: DataFrame) -> Model:
    """A model of texts that `encoded` gave."""
    words = len(known.hashes)
    first = min(EXCHANGED, words)
    # the most frequent words, rare ones, and the others
    kinds = np.where(np.arange(words + 1) < first, np.arange(words + 1), first + 1)
    kinds[words] = first
    pairs = transitions(ids, kinds, first + 2)
    of = exchange(folded(pairs, np.minimum(np.arange(first + 2), first)), first, max(CLASSES, int(np.sqrt(words)) // 8))
    apart = folded(pairs, np.append(of, of[-1] + 1))
    of, table = follow(ids, of[np.minimum(np.arange(words + 1), first)].astype(np.int32), first, known.total, apart=apart)
    return fit(known, of, table)


def folded(pairs: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A matrix of counts with symbols put together; of: where each symbol goes."""
    member = np.zeros((len(pairs), int(of.max()) + 1))
    member[np.arange(len(pairs)), of] = 1
    return member.T @ pairs @ member


def fit(known: Vocabulary, classes: np.ndarray, table: np.ndarray) -> Model:
    count = len(table)
    frequency = (table.sum(axis=0) + 1) / (table.sum() + count)
    after = (table + SMOOTH * frequency) / (table.sum(axis=1, keepdims=True) + SMOOTH)
    sizes = np.bincount(classes[:-1], known.counts, count)
    emitted = np.log10(known.counts / sizes[classes[:-1]])
    rare = known.total - int(known.counts.sum()) + known.distinct - len(known.hashes) + 1
    return Model(known, np.log10(after), emitted, classes, rare)


MEASURED = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, rare_words array<string>, rare_counts array<bigint>"


def score(docs: DataFrame, training: DataFrame | Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, with scores from a model of the training documents.

    `training` is a table, or a condition that tells which of the documents to learn from.
    doc_id; n_tokens, the end included; n_known, those that occur in training;
    train_tokens; base_score, the log10 probability under add-one word frequencies;
    score, that under the class model; perplexity, per token. Null text counts as
    empty and has one token; texts are read whole, however long. With nothing to train on,
    every word is rare and unknown. Extra columns are ignored; rows come back as often as
    they are there; an empty table gives no rows.
    """
    within = isinstance(training, Column)
    taught = F.coalesce(training, F.lit(False)) if within else F.lit(False)
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), taught.alias("taught"), F.col(text).alias("text"))
    lessons = named.filter("taught") if within else training.select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(True).alias("taught"), F.col(text).alias("text")
    )
    with few_rows(docs.sparkSession):
        counts = scratch(word_counts(lessons, "text"), "brown-counts")
        known = vocabulary(counts)
        ids = encoded(named, known)
        taught = ids.filter("taught") if within else encoded(lessons, known)
    model = learn(known, taught)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("vocabulary")
        model = sent.value
        logs = np.log10(model.known.counts + 1.0)
        for batch in slices(batches):
            flat, sizes = batch.column(1).flatten().to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
            columns = [pa.array(x) for x in _measure(flat, sizes, model, logs)]
            names = ["n_tokens", "n_known", "base_score", "score", "rare_words", "rare_counts"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2), batch.column(3)], names=["doc_id", *names])

    found = ids.select("doc_id", "ids", "rare_words", "rare_counts").mapInArrow(run, MEASURED)
    found = scratch(found.withColumn("row", F.monotonically_increasing_id()), "brown-scores")
    rare = found.select("row", F.explode(F.arrays_zip("rare_words", "rare_counts")).alias("x"))
    rare = rare.select("row", F.col("x.rare_words").alias("word"), F.col("x.rare_counts").alias("k"))
    # an unknown word adds log10(0 + 1), which is nothing
    seen = rare.join(counts, "word").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("logs"), F.sum("k").alias("seen")
    )
    logs = F.coalesce("logs", F.lit(0.0))
    unit = float(np.log10(known.total + known.distinct + 1))
    return found.join(seen, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + logs - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("score") + logs).alias("score"),
        F.pow(F.lit(10.0), -(F.col("score") + logs) / F.col("n_tokens")).alias("perplexity"),
    )


def _measure(flat: np.ndarray, sizes: np.ndarray, model: Model, logs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts one after another: tokens, known ones, and both scores as far as they don't need the counts of rare words."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    usual = flat >= 0
    places = model.classes[flat]
    left = np.empty_like(places)
    left[1:] = places[:-1]
    # a text begins after an end
    left[begins] = model.classes[0]
    score = model.after[left, places]
    score[usual] += model.emitted[flat[usual]]
    score[~usual] -= np.log10(model.rare)
    base = np.zeros(len(flat))
    base[usual] = logs[flat[usual]]
    # one text at a time: sums of others would take digits away
    sums = [np.add.reduceat(x, begins) if len(begins) else np.zeros(0) for x in (usual.astype(np.int64), base, score)]
    return sizes.astype(np.int64), sums[0].astype(np.int64), sums[1].astype(np.float64), sums[2].astype(np.float64)

"""Hard negatives by angular triangle filtering.

Vectors are scaled and floored to integers; a score is an integer inner product. Each
row is stored with its norm and its angles to a few reference directions, in the cell
of the nearest one and in order of that angle. By the triangle inequality an anchor
at angle `a` from a reference and a row at angle `t` are between |a - t| and
min(a + t, 2 pi - a - t) apart. So a block of rows has an interval of cosines, and times
the norms bounds of its scores, widened against rounding. Blocks whose bounds miss
what an anchor looks for are passed over; of the others only the window of angles
that can hold it gets integer scoring.

Two searches use this: the best rows of an anchor's own label (positives), then the
best rows of other labels in a window of scores below each positive. A bounded sample
tells scores that the best must reach, so that blocks are passed over from the start;
it decides no result. Anchors go to the tasks in chunks of bounded size; each task
hands on the best it has, which are ranked once more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lurewatch.llm.common import scratch
from lurewatch.session import shared_folder

#: Reference directions, taken from a sample of about this many vectors chosen by a hash of the id, of so many bytes at most.
REFERENCES = 16
SAMPLE = 2000
SAMPLE_BYTES = 16 * 1024 * 1024
#: Bytes of anchors that go to the tasks at once, rows of a block, and anchors scored together.
ANCHOR_BYTES = 8 * 1024 * 1024
BLOCK_ROWS = 4096
TOGETHER = 256
#: What angles may be off by, in radians: far more than the rounding of a cosine next to 1.
SLACK = 1e-6
#: Products of norms below this are exact in doubles.
EXACT = float(1 << 52)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
NONE = np.iinfo(np.int64).min


@dataclass
class Rows:
    """Some rows as arrays; vectors are padded with zeros to one length."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    def take(self, which) -> Rows:
        return Rows(*(getattr(self, n)[which] for n in ("ids", "labels", "values", "norms", "angles")))


def to_integers(vectors: list[list[float]] | pa.Array, scale: float) -> np.ndarray:
    """Vectors scaled and floored, one per row, padded with zeros. What leaves the doubles becomes the largest one."""
    lists = vectors if isinstance(vectors, pa.Array) else pa.array(vectors, pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0))
    with np.errstate(over="ignore"):
        flat = np.nan_to_num(np.floor(scale * flat))
    if len(sizes) * width == len(flat):
        return flat.reshape(len(sizes), width)
    table = np.zeros((len(sizes), width))
    table[np.arange(width) < sizes[:, None]] = flat
    return table


def _widened(table: np.ndarray, width: int) -> np.ndarray:
    return table[:, :width] if table.shape[1] >= width else np.pad(table, ((0, 0), (0, width - table.shape[1])))


def norms_of(values: np.ndarray) -> np.ndarray:
    largest = np.abs(values).max(axis=1, initial=0)
    safe = np.where(largest > 0, largest, 1)
    with np.errstate(over="ignore"):
        return np.nan_to_num(largest * np.sqrt(((values / safe[:, None]) ** 2).sum(axis=1)))


def angles_to(values: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to unit vectors; of a zero vector, a right angle."""
    largest = np.abs(values).max(axis=1, initial=0)
    units = values / np.where(largest > 0, largest, 1)[:, None]
    length = np.sqrt((units**2).sum(axis=1))
    units = units / np.where(length > 0, length, 1)[:, None]
    width = max(units.shape[1], references.shape[1])
    return np.arccos(np.clip(_widened(units, width) @ _widened(references, width).T, -1, 1))


def choose_references(values: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample, each next one the row whose nearest chosen one is farthest."""
    values = values[norms_of(values) > 0]
    if not len(values):
        return np.ones((1, 1))
    chosen = [0]
    nearest = angles_to(values, _unit(values[:1]))[:, 0]
    while len(chosen) < min(count, len(values)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, angles_to(values, _unit(values[chosen[-1:]]))[:, 0])
    return _unit(values[chosen])


def _unit(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(axis=1)[:, None]
    return values / np.sqrt((values**2).sum(axis=1))[:, None]


def scores(anchors: Rows, rows: Rows) -> np.ndarray:
    """Integer inner products; those beyond a long become the nearest long."""
    width = max(anchors.values.shape[1], rows.values.shape[1])
    a, b = _widened(anchors.values, width), _widened(rows.values, width)
    if anchors.norms.max(initial=0) * rows.norms.max(initial=0) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda t: np.array([[int(x) for x in row] for row in t.tolist()], object).reshape(t.shape)
    return np.clip(whole(a) @ whole(b).T, LEAST, MOST).astype(np.int64) if width else np.zeros((len(a), len(b)), np.int64)


# --- bounds -----------------------------------------------------------------------


def block_bounds(anchors: Rows, block: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score each anchor can have with any row of the block."""
    low, high = block.angles.min(axis=0), block.angles.max(axis=0)
    a = anchors.angles
    nearest = np.maximum(np.maximum(a - high, low - a).max(axis=1) - SLACK, 0)
    farthest = np.minimum(np.minimum(a + high, 2 * np.pi - a - low).min(axis=1) + SLACK, np.pi)
    least, most = block.norms.min(), block.norms.max()
    with np.errstate(over="ignore", invalid="ignore"):
        margin = 1 + 1e-9 * anchors.norms * most
        up, down = np.cos(nearest), np.cos(farthest)
        greatest = anchors.norms * np.where(up >= 0, most, least) * up + margin
        smallest = anchors.norms * np.where(down >= 0, least, most) * down - margin
    # beyond the doubles nothing is known
    return np.where(np.isnan(smallest), -np.inf, smallest), np.where(np.isnan(greatest), np.inf, greatest)


def angle_windows(anchors: Rows, block: Rows, cell: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a block, sorted by their angle to its reference, can score from `low` to `high`: first, and one past the last."""
    least, most = block.norms.min(), block.norms.max()
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        small = low / (anchors.norms * np.where(low >= 0, most, least))
        large = high / (anchors.norms * np.where(high >= 0, least, most))
    # without a norm to divide by nothing is known
    far = np.arccos(np.clip(np.where(np.isnan(small), -1, small), -1, 1)) + SLACK
    near = np.arccos(np.clip(np.where(np.isnan(large), 1, large), -1, 1)) - SLACK
    a, stored = anchors.angles[:, cell], block.angles[:, cell]
    first = np.searchsorted(stored, np.maximum(a - far, near - a) - SLACK, "left")
    past = np.searchsorted(stored, np.minimum(a + far, 2 * np.pi - near - a) + SLACK, "right")
    return first, past


class Best:
    """The best `size` rows of each of many searches: highest score, then smallest id."""

    def __init__(self, searches: int, size: int, floor: np.ndarray):
        self.size, self.floor = size, floor.copy()
        self.held = [np.zeros(0, np.int64) for _ in range(3)]
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.pending.append((search, score, ids))
        self.waiting += len(search)
        if self.waiting > 4 * (len(self.held[0]) + TOGETHER * BLOCK_ROWS // 16):
            self.settle()

    def settle(self) -> None:
        search, score, ids = (np.concatenate([h, *(p[i] for p in self.pending)]) for i, h in enumerate(self.held))
        self.pending, self.waiting = [], 0
        order = np.lexsort((ids, ~score, search))
        search, score, ids = search[order], score[order], ids[order]
        place = np.arange(len(search)) - np.searchsorted(search, search)
        keep = place < self.size
        last = place == self.size - 1
        self.floor[search[last]] = np.maximum(self.floor[search[last]], score[last])
        self.held = [search[keep], score[keep], ids[keep]]


def blocks_of(rows: Rows) -> Iterator[tuple[int, Rows]]:
    """The rows by cell, in order of their angle to its reference, in blocks of bounded size."""
    if not len(rows.ids):
        return
    cells = rows.angles.argmin(axis=1)
    order = np.lexsort((rows.angles[np.arange(len(cells)), cells], cells))
    rows, cells = rows.take(order), cells[order]
    for cell in np.unique(cells).tolist():
        begin, end = np.searchsorted(cells, (cell, cell + 1))
        for at in range(begin, end, BLOCK_ROWS):
            yield cell, rows.take(slice(at, min(at + BLOCK_ROWS, end)))


def search(
    blocks: Iterator[tuple[int, Rows]], anchors: Rows, low: np.ndarray, high: np.ndarray, best: Best,
    fits: Callable[[Rows, Rows], np.ndarray],
) -> None:
    """Puts in `best` what scores from `low` to `high` (anchors x searches per anchor) among the rows that fit."""
    kinds = low.shape[1]
    for cell, block in blocks:
        floor = np.maximum(low, best.floor.reshape(low.shape))
        smallest, greatest = block_bounds(anchors, block)
        live = ((greatest[:, None] >= floor) & (smallest[:, None] <= high) & (floor <= high)).any(axis=1)
        which = np.flatnonzero(live)
        if not len(which):
            continue
        some = anchors.take(which)
        wanted = floor[which] <= high[which]
        least = np.where(wanted, floor[which], MOST).min(axis=1).astype(float)
        most = np.where(wanted, high[which], LEAST).max(axis=1).astype(float)
        first, past = angle_windows(some, block, cell, least, most)
        # anchors with like windows together
        order = np.lexsort((past, first))
        order = order[first[order] < past[order]]
        for at in range(0, len(order), TOGETHER):
            part = order[at : at + TOGETHER]
            window = slice(int(first[part].min()), int(past[part].max()))
            few, rows, place = some.take(part), block.take(window), which[part]
            found = scores(few, rows)
            may = fits(few, rows)
            for kind in range(kinds):
                near = (found >= floor[place, kind][:, None]) & (found <= high[place, kind][:, None]) & may
                a, r = np.nonzero(near)
                if len(a):
                    best.add(place[a] * kinds + kind, found[a, r], rows.ids[r])
    best.settle()


def same_label(anchors: Rows, rows: Rows) -> np.ndarray:
    return (anchors.labels[:, None] == rows.labels) & (anchors.ids[:, None] != rows.ids)


def other_label(anchors: Rows, rows: Rows) -> np.ndarray:
    return (anchors.labels[:, None] != rows.labels) & (anchors.ids[:, None] != rows.ids)


# --- the operator -----------------------------------------------------------------


def usable(vectors: DataFrame, vec_id: str, label: str, embedding: str) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    named = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
        F.col(embedding).cast("array<double>").alias("embedding"),
    )
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return named.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(~odd)


STORED = "vec_id bigint, label bigint, vector array<double>, norm double, angles array<double>, cell int, nearest double"


def _stored(rows: DataFrame, references: np.ndarray, scale: float) -> DataFrame:
    """The rows with norm and angles, in order of cell and angle, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                values = to_integers(some.column(2), scale)
                angles = angles_to(values, references)
                cell = angles.argmin(axis=1)
                columns = [
                    some.column(0), some.column(1), _lists(values), pa.array(norms_of(values)), _lists(angles),
                    pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STORED.split(", ")])

    angled = rows.mapInArrow(run, STORED)
    # ids split a hot angle: copies of one vector do not meet in one task
    dealt = angled.repartitionByRange("cell", "nearest", "vec_id").sortWithinPartitions("cell", "nearest", "vec_id")
    return scratch(dealt, "angles")


def _lists(table: np.ndarray) -> pa.Array:
    offsets = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()))


def _rows(batch: pa.RecordBatch) -> Rows:
    ids, labels, norms = (batch.column(i).to_numpy() for i in (0, 1, 3))
    return Rows(ids, labels, to_integers(batch.column(2), 1), norms, table_of(batch.column(4)))


def table_of(lists: pa.Array) -> np.ndarray:
    """A list column of one length as a table."""
    flat = lists.flatten().to_numpy()
    return flat.reshape(len(lists), -1)


def _to_rows(table: pa.Table) -> Rows:
    batches = table.select(["vec_id", "label", "vector", "norm", "angles"]).combine_chunks().to_batches()
    if not batches:
        return Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 1)))
    return _rows(batches[0])


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding",
    positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: float = 256.0,
) -> DataFrame:
    """For each anchor and each of its positives the hardest negatives in a window of scores below it.

    `is_anchor` is a condition on `vec_id`. Components become floor(scale * x); scores are integer inner
    products, higher ones first, ties by smaller id. Positives are the first rows of the anchor's label; negatives
    the first rows of other labels with low_percent * positive_score <= 100 * negative_score <=
    high_percent * positive_score. Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    Rows with a null id or label, a null vector or a null or non-finite component take no
    part. A shorter vector counts as if it went on with zeros; empty and zero vectors score
    0. Scores beyond a long become the nearest long. Repeated rows are rows of their own, as
    anchors too, but a row with the anchor's id is never its positive or negative. Other
    columns are ignored; an empty table, or one without anchors, gives no rows.
    """
    rows = usable(vectors, vec_id, label, embedding)
    spark = rows.sparkSession
    figures = rows.agg(
        F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"),
        F.count(F.when(is_anchor, 1)).alias("anchors"),
    ).first()
    width = max(figures.width or 1, 1)
    wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    share = (1 << 30) if figures.n <= wanted else (1 << 30) * wanted // figures.n
    chosen = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share)
    # a hot id may bring in more rows than its share
    sample = chosen.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * wanted).toArrow()
    values = to_integers(sample.column("embedding").combine_chunks(), scale)
    references = choose_references(values, REFERENCES)
    known = Rows(
        sample.column("vec_id").to_numpy(), sample.column("label").to_numpy(), values, norms_of(values), angles_to(values, references)
    )
    stored = _stored(rows, references, scale)
    chunks = -(-figures.anchors * 8 * (width + REFERENCES) // ANCHOR_BYTES) or 1
    folders = []
    for chunk in range(chunks):
        mine = stored.filter(is_anchor & (F.pmod(F.xxhash64("vec_id", "label"), F.lit(chunks)) == chunk))
        anchors = _to_rows(mine.toArrow())
        folders.append(shared_folder(spark, "hard-negatives"))
        _mine(spark, stored, anchors, known, positives, negatives, low_percent, high_percent).write.parquet(folders[-1])
    return spark.read.schema(RESULT).parquet(*folders)


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
FOUND = "search bigint, score bigint, id bigint"


def _searched(
    stored: DataFrame, anchors: Rows, low: np.ndarray, high: np.ndarray, floor: np.ndarray, size: int, fits: Callable
) -> DataFrame:
    """(search, rank, id, score): the best rows of all tasks."""
    sent = stored.sparkSession.sparkContext.broadcast((anchors, low, high, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high, floor = sent.value
        best = Best(low.size, size, floor)
        blocks = (b for batch in batches for b in blocks_of(_rows(batch)))
        search(blocks, anchors, low, high, best, fits)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.held], names=["search", "score", "id"])

    columns = stored.select("vec_id", "label", "vector", "norm", "angles")
    order = Window.partitionBy("search").orderBy(F.desc("score"), "id")
    found = columns.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order))
    return found.filter(F.col("rank") <= size)


def _floors(known: Rows, anchors: Rows, low: np.ndarray, high: np.ndarray, size: int, fits: Callable) -> np.ndarray:
    """Scores that the last of each search's best rows reaches at least, as the sample shows."""
    best = Best(low.size, size, np.full(low.size, NONE))
    search(blocks_of(known), anchors, low, high, best, fits)
    return best.floor


def _mine(
    spark, stored: DataFrame, anchors: Rows, known: Rows, positives: int, negatives: int, low_percent: int, high_percent: int
) -> DataFrame:
    n = len(anchors.ids)
    low, high = np.full((n, 1), LEAST + 1), np.full((n, 1), MOST)
    floor = _floors(known, anchors, low, high, positives, same_label)
    found = _searched(stored, anchors, low, high, floor, positives, same_label).toArrow()
    place, rank, ids, score = (found.column(c).to_numpy() for c in ("search", "rank", "id", "score"))
    there = np.zeros((n, positives), bool)
    positive_id, positive_score = np.zeros((2, n, positives), np.int64)
    there[place, rank - 1], positive_id[place, rank - 1], positive_score[place, rank - 1] = True, ids, score
    bounds = [(-(-low_percent * s // 100), high_percent * s // 100) for s in positive_score.ravel().tolist()]
    low, high = (np.array([b[i] for b in bounds], np.int64).reshape(n, positives) for i in (0, 1))
    low, high = np.where(there, low, 1), np.where(there, high, 0)
    floor = _floors(known, anchors, low, high, negatives, other_label)
    found = _searched(stored, anchors, low, high, floor, negatives, other_label)
    sent = spark.sparkContext.broadcast((anchors.ids, positive_id, positive_score))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_id, positive_id, positive_score = sent.value
        for batch in batches:
            place, score, ids, rank = (batch.column(i) for i in range(4))
            at = place.to_numpy()
            columns = [
                pa.array(anchor_id[at // positives]), pa.array(positive_id.ravel()[at]), rank, ids,
                pa.array(positive_score.ravel()[at]), score,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    return found.select("search", "score", "id", "rank").mapInArrow(named, RESULT)

"""Quality: logistic regression on hashed word n-grams, trained by following the regularised leader.

Tokens are runs of letters and digits, and runs of signs. Words, pairs of words
and the pair of a word with itself are hashed to coordinates; a text is the vector of their counts, of length one.
Training keeps, per coordinate, the sum of adjusted gradients and of their squares;
weights follow from both, and are zero where the first stays below the L1 term.
Shards of the sample train side by side; after each pass their sums are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lurewatch.llm.common import add_from_text, once, scratch
from lurewatch.llm.labelled import labelled_sample
from lurewatch.llm.simhash import LOWER

BITS = 18
#: Rows a model learns from, at most about this many: a bounded sample by a hash of the id.
MAX_ROWS = 30_000
#: Fixed number of shards, so that a model does not depend on the cluster.
SHARDS = 8
PASSES = 6
ALPHA, BETA, L1, L2 = 2.0, 0.1, 0.005, 0.01
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
AGAIN = np.uint64(0x5851F42D4C957F2D)
KINDS = np.array([0 if b in b" \t\n\r\x0b\x0c" else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


def _powers(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, as many as the longest text so far needs."""
    size = 1 << max(16, least.bit_length())

    def build() -> tuple[np.ndarray, np.ndarray]:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        rows = []
        for base in (BASE, inverse):
            some = np.full(size, base, np.uint64)
            some[0] = 1
            rows.append(np.cumprod(some))
        return rows[0], rows[1]

    return once("powers", size, build)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def token_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the tokens in order: polynomials of their bytes, from running sums."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    kind = KINDS[raw]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], edge))
    ends = np.concatenate((edge, [len(raw)]))
    token = kind[starts] > 0
    starts, ends = starts[token], ends[token]
    powers, inverses = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts])


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of a text; coordinate 0 is the constant 1."""
    one = token_hashes(text)
    two = mix(one[:-1] * np.uint64(3) + one[1:])
    # a word said twice in a row is a pair of its own kind, whatever the word
    twice = np.full(int((one[1:] == one[:-1]).sum()), AGAIN)
    where = np.concatenate((one, two, twice)) >> np.uint64(64 - bits)
    where, counts = np.unique(where, return_counts=True)
    values = np.sqrt(counts)
    values = values / max(1.0, np.sqrt(counts.sum()))
    return np.concatenate(([0], where.astype(np.int64) + 1)), np.concatenate(([1.0], values))


@dataclass
class Model:
    """z and n: the sums per coordinate."""

    z: np.ndarray
    n: np.ndarray

    @staticmethod
    def empty(bits: int = BITS) -> Model:
        return Model(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1))

    def weights(self, where: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[where], self.n[where]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, where: np.ndarray, values: np.ndarray, label: int) -> None:
        weights = self.weights(where)
        gradient = (sigmoid(float(weights @ values)) - label) * values
        squares = gradient * gradient
        sigma = (np.sqrt(self.n[where] + squares) - np.sqrt(self.n[where])) / ALPHA
        self.z[where] += gradient - sigma * weights
        self.n[where] += squares


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def score(weights: np.ndarray, text: str | None) -> float:
    where, values = features(text)
    return sigmoid(float(weights[where] @ values))


def _pack(table: pa.Table) -> pa.Table:
    """A shard's rows as one, in an order of its own."""
    table = table.sort_by([("turn", "ascending"), ("doc_id", "ascending"), ("label", "ascending")])
    w, v = (table[c].combine_chunks() for c in ("w", "v"))
    row = {
        "sizes": pa.array([w.value_lengths().to_pylist()], pa.list_(pa.int32())),
        "labels": pa.array([table["label"].to_pylist()], pa.list_(pa.int32())),
        "w": pa.array([w.flatten().to_numpy().astype("<i4").tobytes()], pa.binary()),
        "v": pa.array([v.flatten().to_numpy().astype("<f4").tobytes()], pa.binary()),
    }
    return pa.table(row)


def _one_pass(sent):
    """Learns each shard from the model sent; a row for each coordinate it has met."""

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                own = Model(sent.value.z.copy(), sent.value.n.copy())
                w, v = np.frombuffer(shard["w"], "<i4"), np.frombuffer(shard["v"], "<f4").astype(np.float64)
                at = 0
                for size, label in zip(shard["sizes"], shard["labels"]):
                    own.learn(w[at : at + size], v[at : at + size], label)
                    at += size
                where = np.flatnonzero(own.n).astype(np.int32)
                columns = [where, own.z[where].astype(np.float32), own.n[where].astype(np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "z", "n"])

    return one_pass


def train(docs: DataFrame, labels: DataFrame, label: str, allowed, max_rows: int = MAX_ROWS, passes: int = PASSES) -> Model:
    """A model from labelled documents that `allowed` lets in (a condition on doc_id).

    The vectors of the sample are dealt out to the shards once. In each pass every shard starts
    from the same model; what comes back is one average per coordinate, whose number
    is fixed. Null and empty texts teach the constant; a document with several labels counts
    once for each. Without labelled rows the model is empty and every score is 0.5.
    """
    sample = labelled_sample(docs, labels, label, allowed, max_rows)

    def compute():
        def work(texts: list[str | None]) -> list[pa.Array]:
            found = [features(t) for t in texts]
            return [
                pa.array([w.astype(np.int32) for w, _ in found], pa.list_(pa.int32())),
                pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())),
            ]

        return work

    vectors = add_from_text(sample, "text", "w array<int>, v array<float>", compute)
    shard = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)).cast("int")
    vectors = vectors.select(shard.alias("shard"), F.xxhash64("doc_id", F.lit(2)).alias("turn"), "doc_id", "label", "w", "v")
    packed = vectors.groupBy("shard").applyInArrow(_pack, "sizes array<int>, labels array<int>, w binary, v binary")
    shards = scratch(packed, "quality-shards")
    model = Model.empty()
    for _ in range(passes):
        sent = docs.sparkSession.sparkContext.broadcast(model)
        moved = shards.mapInArrow(_one_pass(sent), "i int, z float, n float")
        table = moved.groupBy("i").agg(F.sum("z").alias("z"), F.sum("n").alias("n"), F.count("*").alias("k")).toArrow()
        # a coordinate is averaged over the shards that have met it
        i, k = table["i"].to_numpy(), table["k"].to_numpy()
        model = Model.empty()
        model.z[i], model.n[i] = table["z"].to_numpy() / k, table["n"].to_numpy() / k
    return model


def add_score(docs: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """Adds the probability of label 1, from the whole text.

    Null and empty texts have the score of the constant alone. Texts are read whole,
    however long. A column of the same name is replaced; rows come back as often as they
    are there; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.weights().astype(np.float32))

    def compute():
        return lambda texts: [pa.array([score(sent.value, t) for t in texts], pa.float64())]

    return add_from_text(docs, text, f"`{output}` double", compute)

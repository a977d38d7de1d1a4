"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes by a learned rotation: principal directions of a bounded
sample, turned so that signs lose least (iterative quantisation). Inner products
become angles by one more coordinate, which fills every vector up to the greatest
norm. A code is cut into substrings of 8 bits, and every block of codes is indexed
by each of them. If codes are within radius r, then in some of m substrings they
are within r // m; those buckets are probed, what they hold is verified on the
whole code, and all within the radius are reranked by their inner products.

Every query has a radius of its own: that of its nearest rows in a small sample, and
some bits more. A query in a cluster probes little, an isolated one far. Queries that
find too few rows ask again, round by round with a larger radius, up to all bits.

Queries go to all tasks in chunks of bounded size; each task keeps its best, and
the best of all tasks are ranked once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lurewatch.llm.common import scratch

BITS = 64
#: Vectors the rotation and the radius are learned from, at most about this many: a bounded sample by a hash of the id.
SAMPLE = 20_000
#: Vectors that tell how far a query must look, at most; nearest ones of them it must take in; and bits more.
GAUGE = 2000
GAUGE_NEAREST = 8
MORE_BITS = 1
#: Bits by which a query that found too little looks farther.
FARTHER = 8
TURNS = 30
#: Bytes of query vectors that go to the tasks at once; rows indexed and queries asked together.
QUERY_BYTES = 16 * 1024 * 1024
BLOCK_ROWS = 8192
ASKED = 1024
DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part, all of one dimension: that of most."""
    named = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = named.filter(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    sizes = found.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.filter(F.size("embedding") == (sizes.d if sizes else 0))


@dataclass
class Coder:
    mean: np.ndarray
    turn: np.ndarray
    norm: float

    @property
    def bytes(self) -> int:
        return -(-self.turn.shape[1] // 8)

    def codes(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Codes as rows of bytes. A stored vector is filled up to the greatest norm, a query is not."""
        scaled = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) if query else self.norm)
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.clip(1 - (scaled**2).sum(axis=1), 0, None))
        filled = np.column_stack((scaled, rest))
        return np.packbits((filled - self.mean) @ self.turn > 0, axis=1)


def learn(sample: np.ndarray, norm: float, bits: int = BITS) -> Coder:
    """The rotation."""
    scaled = sample / norm
    filled = np.column_stack((scaled, np.sqrt(np.clip(1 - (scaled**2).sum(axis=1), 0, None))))
    mean = filled.mean(axis=0)
    centred = filled - mean
    _, directions = np.linalg.eigh(centred.T @ centred)
    directions = directions[:, ::-1][:, : min(bits, filled.shape[1])]
    flat = centred @ directions
    turn = np.linalg.qr(np.random.default_rng(0).standard_normal((flat.shape[1],) * 2))[0]
    for _ in range(TURNS):
        signs = np.where(flat @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ flat)
        turn = (left @ right).T
    return Coder(mean, directions @ turn, norm)


def radii(coder: Coder, gauge: np.ndarray, gauge_ids: np.ndarray, asked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How far each query looks: as far as its nearest vectors of the gauge, and a little more."""
    stored = _words(coder.codes(gauge, False))
    found = np.full(len(asked), 8 * coder.bytes)
    for at in range(0, len(asked), ASKED):
        part = slice(at, at + ASKED)
        scores = asked[part] @ gauge.T
        own = ids[part][:, None] == gauge_ids
        scores[own] = -np.inf
        count = min(GAUGE_NEAREST, scores.shape[1])
        if not count:
            continue
        best = np.argpartition(-scores, count - 1, axis=1)[:, :count]
        apart = sum(np.bitwise_count(a[:, None] ^ b[best]) for a, b in zip(_words(coder.codes(asked[part], True)), stored))
        # what is no candidate tells nothing
        apart = np.where(np.isfinite(np.take_along_axis(scores, best, axis=1)), apart, 0)
        found[part] = np.minimum(apart.max(axis=1) + MORE_BITS, 8 * coder.bytes)
    return found


class Index:
    """A block of codes: for each substring its rows by key."""

    def __init__(self, stored: np.ndarray):
        self.size, self.words = len(stored), _words(stored)
        self.orders = [np.argsort(column, kind="stable") for column in stored.T]
        self.begins = [np.searchsorted(column[order], np.arange(257)) for column, order in zip(stored.T, self.orders)]


def within(asked: np.ndarray, index: Index, radius: np.ndarray) -> np.ndarray:
    """For all queries and a block of rows, whether codes are within each query's radius, by probing the substrings' buckets."""
    parts = asked.shape[1]
    found = np.zeros((len(asked), index.size), bool)
    words = _words(asked)
    least, more = np.divmod(radius, parts)
    for j in range(parts):
        order, begins = index.orders[j], index.begins[j]
        # the first substrings are probed to radius // parts, the others to one less: that takes in every code
        reach = np.where(j <= more, least, least - 1)
        for probe in np.unique(reach * 256 + asked[:, j].astype(np.int64)).tolist():
            far, key = divmod(probe, 256)
            if far < 0:
                continue
            near = np.flatnonzero(DISTANCE[key] <= far)
            rows = np.concatenate([order[begins[k] : begins[k + 1]] for k in near])
            if not len(rows):
                continue
            who = np.flatnonzero((asked[:, j] == key) & (reach == far))
            apart = sum(np.bitwise_count(a[who][:, None] ^ b[rows]) for a, b in zip(words, index.words))
            q, r = np.nonzero(apart <= radius[who][:, None])
            found[who[q], rows[r]] = True
    return found


def _words(codes: np.ndarray) -> list[np.ndarray]:
    """Codes as 64-bit words, by place in the code."""
    padded = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    padded[:, : codes.shape[1]] = codes
    return list(np.ascontiguousarray(padded.view(np.uint64).T))


def _best(ids: np.ndarray, scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * count:
        cut = np.partition(scores, len(scores) - count)[len(scores) - count]
        keep = scores >= cut
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:count]
    return ids[order], scores[order]


def nearest(
    vectors: DataFrame, every: int = 20, neighbours: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
    sample_rows: int = SAMPLE, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """For each query the nearest found: query_id, rank (from 1), vec_id, score; by inner product, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; a row of the query's own
    id is no candidate. Rows without an id, and vectors that are null, zero, of
    another dimension than most, or hold null or non-finite components, take no part. Of
    several rows with a query's id one is asked; a repeated candidate is listed as
    often as it is there. Every query lists `neighbours` rows, or all candidates if
    there are fewer. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    # coordinate by coordinate in order, as everywhere else
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(square)).alias("norm"), F.max(F.size("embedding")).alias("d")).first()
    schema = "query_id bigint, vec_id bigint, score double"
    if not facts.n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    steps = 1 << 20
    share = steps if facts.n <= sample_rows else max(1, steps * sample_rows // facts.n)
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(steps)) < share).orderBy(F.xxhash64("vec_id"), "vec_id").toArrow()
    learnt = _matrix(sample["embedding"].combine_chunks(), facts.d)
    coder = learn(learnt, facts.norm)
    gauge, gauge_ids = learnt[:GAUGE], sample["vec_id"].to_numpy()[:GAUGE]
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = scratch(queries, "mih-queries")
    chunks = -(-queries.count() * facts.d * 8 // query_bytes) or 1
    found = []
    for k in range(chunks):
        part = queries if chunks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == k)
        table = part.toArrow()
        ids = table["vec_id"].to_numpy()
        asked = _matrix(table["embedding"].combine_chunks(), facts.d)
        radius = radii(coder, gauge, gauge_ids, asked, ids)
        while len(ids):
            sent = spark.sparkContext.broadcast((coder, ids, asked, radius))
            best = _ranked(rows.mapInArrow(_search(sent, neighbours), schema), neighbours)
            best = scratch(best, "mih-found")
            counts = best.groupBy("query_id").agg(F.count("*").alias("n")).toArrow()
            got = dict(zip(counts["query_id"].to_pylist(), counts["n"].to_pylist()))
            short = np.array([got.get(i, 0) < neighbours for i in ids.tolist()]) & (radius < 8 * coder.bytes)
            if short.any():
                again = spark.createDataFrame([(i,) for i in ids[short].tolist()], "query_id bigint")
                best = best.join(again, "query_id", "left_anti")
            found.append(best)
            ids, asked, radius = ids[short], asked[short], np.minimum(radius[short] + FARTHER, 8 * coder.bytes)
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return reduce(DataFrame.unionByName, found, none)


def _ranked(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(lists: pa.Array, dimension: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _search(sent, neighbours: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, query_ids, queries, radius = sent.value
        if not len(query_ids):
            return
        asked = coder.codes(queries, True)
        best_ids = [np.zeros(0, np.int64)] * len(query_ids)
        best_scores = [np.zeros(0)] * len(query_ids)

        def block(ids: np.ndarray, vectors: np.ndarray) -> None:
            index = Index(coder.codes(vectors, False))
            for at in range(0, len(query_ids), ASKED):
                near = within(asked[at : at + ASKED], index, radius[at : at + ASKED])
                for i, row in enumerate(near, at):
                    rows = np.flatnonzero(row)
                    rows = rows[ids[rows] != query_ids[i]]
                    if len(rows):
                        scores = np.einsum("ij,j->i", vectors[rows], queries[i])
                        both = np.concatenate((best_ids[i], ids[rows])), np.concatenate((best_scores[i], scores))
                        best_ids[i], best_scores[i] = _best(*both, neighbours)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            vectors = _matrix(batch.column(1), queries.shape[1])
            for at in range(0, len(ids), BLOCK_ROWS):
                block(ids[at : at + BLOCK_ROWS], vectors[at : at + BLOCK_ROWS])
        counts = [len(x) for x in best_ids]
        columns = [np.repeat(query_ids, counts), np.concatenate(best_ids), np.concatenate(best_scores)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run

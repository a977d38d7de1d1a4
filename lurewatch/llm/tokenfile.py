"""Token-id files in Simple-8b, a word-aligned code.

A block holds the ids of consecutive documents as 64-bit little-endian words. The
top four bits of a word select how many ids it packs and in how many bits each;
selector 0 stands for one id of more than 60 bits, taken from the block's list of
escapes. The index of a block gives, for each document, its id, and where its ids
begin; so a block is decoded at once, without a loop over its words.

The container is Parquet, one row per block, sorted: it is written through Spark's
commit protocol to any store Spark reaches, so that a repeated task leaves no
second copy. Columns: shard, block, doc_ids, lengths, words, escapes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lurewatch.llm.common import once, slices
from lurewatch.llm.pieces import PieceTable, grouped

#: Fixed by the format: ids per word for the selectors 1 to 14, each of 60 // count bits.
COUNTS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK_IDS = 1 << 16
BITS_OF = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
SCHEMA = "shard int, block bigint, doc_ids array<bigint>, lengths array<bigint>, words binary, escapes binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of unsigned 64-bit ids, each word taking as many ids as fit."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if ids.max() < len(BITS_OF):
        bits = BITS_OF[ids]
    else:  # exact, as the halves of an id have no more bits than a float holds
        high, low = (ids >> np.uint64(32)).astype(np.float64), (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
        bits = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.uint8)
    # spans[w][i]: most bits among the w ids from i on; past the end nothing fits
    past = np.full(COUNTS[-1], 255, np.uint8)
    spans, span = {1: np.concatenate((bits, past))}, 1
    best = (bits <= 60).astype(np.uint8)
    for selector, count in enumerate(COUNTS[1:], 2):
        # `count` ids are covered by two windows of the largest power of two in it
        while span * 2 <= count:
            spans[span * 2] = np.maximum(spans[span], np.concatenate((spans[span][span:], past[:span])))
            span *= 2
        window = np.maximum(spans[span][:n], spans[span][count - span :][:n])
        np.maximum(best, (window <= 60 // count).view(np.uint8) * np.uint8(selector), out=best)
    steps = np.array([1, *COUNTS], np.uint8)[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    place = np.array(starts)
    chosen = best[place]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, count in enumerate(COUNTS, 1):
        rows = np.flatnonzero(chosen == selector)
        if len(rows):
            width = 60 // count
            shifts = (np.arange(count, dtype=np.uint64) * np.uint64(width))
            words[rows] |= np.bitwise_or.reduce(ids[place[rows][:, None] + np.arange(count)] << shifts, axis=1)
    return words, ids[place[chosen == 0]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of a block, as unsigned 64-bit integers."""
    chosen = (words >> np.uint64(60)).astype(np.intp)
    counts = np.array([1, *COUNTS])[chosen]
    ends = np.cumsum(counts)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    begins = ends - counts
    for selector, count in enumerate(COUNTS, 1):
        rows = np.flatnonzero(chosen == selector)
        if len(rows):
            width = 60 // count
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            values = (words[rows][:, None] >> shifts) & np.uint64((1 << width) - 1)
            ids[begins[rows][:, None] + np.arange(count)] = values
    ids[begins[chosen == 0]] = escapes
    return ids


def _byte_letters() -> dict[int, int]:
    """Fixed by byte-level BPE: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class Tokens:
    """Ids of texts by the tokenizers library; a piece is encoded once as long as it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole, letters = Tokenizer.from_file(path), _byte_letters()
        model = self.whole.model
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

        def encode(pieces: list[bytes]) -> list[list[int]]:
            return [[t.id for t in model.tokenize(p.decode("latin-1").translate(letters))] for p in pieces]

        self.table = PieceTable(encode)

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; one that holds an added token is left to the library as a whole."""
        apart = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        found = self.table.ids_of(["" if i in apart else t for i, t in enumerate(texts)])
        for i in apart:
            found[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return found


def write_tokens(
    docs: DataFrame, path: str, folder: str, doc_id: str = "doc_id", text: str = "text", end: int = 0, block_ids: int = BLOCK_IDS
) -> None:
    """Writes the token ids of all documents, in ascending order of id, below `folder`.

    `path` is a tokenizer file of byte-level BPE with the public pattern, on every
    machine. Each document is followed by the id `end`; null and empty texts have
    that id alone. Documents without an id come first; documents of the same id
    are ordered by text. A document is never divided: one longer than a block has
    a block of its own. Extra columns are ignored; an empty table writes no block.
    """
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = once("tokenizer", path, lambda: Tokens(path))
        last = np.array([end], "<u4")
        held, names, count, block, shard = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            words, escapes = pack(np.concatenate([x for ids in held for x in (ids, last)]))
            row = {
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int64()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "lengths": pa.array([[len(x) + 1 for x in held]], pa.list_(pa.int64())),
                "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                "escapes": pa.array([escapes.astype("<u8").tobytes()], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in slices(batches):
            ids = iter(batch.column(0).to_pylist())
            if batch.num_rows:
                shard = batch.column(2)[0].as_py()
            for some in grouped(batch.column(1).to_pylist()):
                for found in known.ids_of(some):
                    held.append(found)
                    names.append(next(ids))
                    count += len(found) + 1
                    if count >= block_ids:
                        yield close()
                        held, names, count, block = [], [], 0, block + 1
        if held:
            yield close()

    ordered.mapInArrow(run, SCHEMA).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), token_ids, ids_crc32.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.

    Starts are sums over the lengths in the index. The driver sees one number per
    shard; blocks of a shard follow one another in its file, and are decoded where
    they are read.
    """
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    size = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sizes = blocks.select("shard", "block", size.alias("n"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("outer"))
    before = sizes.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(shards, "shard")
    before = before.select("shard", "block", (F.col("inner") + F.col("outer")).alias("before"))
    placed = blocks.join(before, ["shard", "block"]).select("before", "doc_ids", "lengths", "words", "escapes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8"))
                ends = np.cumsum([0, *row["lengths"]], dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int64)))
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + ends[:-1]), lists, pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "token_ids", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id bigint, start bigint, token_ids array<bigint>, ids_crc32 bigint")

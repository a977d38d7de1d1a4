"""Benchmark decontamination: one Aho-Corasick automaton over the test items.

Items and documents are normalised to lower-case words with single spaces. Every
window of consecutive item words is a pattern, bounded by spaces; a document is
scanned once, and what is found is mapped back to the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lurewatch.llm.common import add_from_text, drop_clashing, once, scratch

WINDOW = 13
#: Text of items in one automaton; a larger benchmark is scanned for in several rounds.
BLOCK_BYTES = 16 * 1024 * 1024
#: Fixed by the contract: a word is a run of digits, letters a-z (after lowering A-Z) and all beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or b in ASCII_WORD else 32 for b in range(256)
)
#: Lowering A-Z keeps every position, so the words' places in the lowered text are those in the original.
LOWER = {c: c + 32 for c in range(65, 91)}
RESULT = (
    "n_words bigint, n_hit bigint, hits array<struct<start:bigint,end:bigint>>, "
    "item_ids array<bigint>, contaminated boolean"
)


def words_of(text: str | None) -> list[str]:
    folded = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    return [w.decode("utf-8", "surrogatepass") for w in folded.split(b" ") if w]


def automaton(items: list[tuple[int | None, str | None]], window: int) -> ahocorasick.Automaton | None:
    """Windows of all items; a window's value is its number of words and the ids of its items."""
    found: dict[str, tuple[int, set]] = {}
    for item_id, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            key = " " + " ".join(words[at : at + size]) + " "
            found.setdefault(key, (size, set()))[1].add(item_id)
    if not found:
        return None
    built = ahocorasick.Automaton()
    for key, (size, ids) in found.items():
        built.add_word(key, (size, frozenset(ids)))
    built.make_automaton()
    return built


def scan(text: str | None, built: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, ranges of words that are hit (merged, end exclusive), ids of the items found."""
    folded = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).decode("utf-8", "surrogatepass")
    words = folded.split(" ")
    words = [w for w in words if w]
    if built is None or not words:
        return len(words), [], set()
    line = " " + " ".join(words) + " "
    spaces = None
    ranges: list[tuple[int, int]] = []
    ids: set = set()
    for end, (size, items) in built.iter(line):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
        last = int(np.searchsorted(spaces, end))
        first = last - size
        while ranges and first <= ranges[-1][1]:
            low, high = ranges.pop()
            first, last = min(first, low), max(last, high)
        ranges.append((first, last))
        ids |= items
    return len(words), ranges, ids


def _compute(built_for):
    def compute():
        built = built_for()

        def work(texts: list[str | None]) -> list[pa.Array]:
            n_words, n_hit, hits, items = [], [], [], []
            for text in texts:
                count, ranges, ids = scan(text, built)
                n_words.append(count)
                n_hit.append(sum(b - a for a, b in ranges))
                places = list(WORD.finditer(text.translate(LOWER))) if ranges else []
                hits.append([{"start": places[a].start(), "end": places[b - 1].end()} for a, b in ranges])
                items.append(sorted(i for i in ids if i is not None))
            bad = [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return [
                pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, kind),
                pa.array(items, pa.list_(pa.int64())), pa.array(bad, pa.bool_()),
            ]

        return work

    return compute


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of bounded text, one after the other."""
    size = items.agg(F.sum(F.length(F.col("text").cast("binary"))).alias("b")).first().b or 0
    blocks = -(-2 * size // block_bytes) if size > block_bytes else 1
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds what of the benchmark is found in each document.

    `n_words`; `n_hit`, the words inside any occurrence of a window; `hits`, their
    ranges as code points of the original text; `item_ids`, the items found, in
    order; `contaminated`, if at least one word in twenty is hit. A window is
    `window` consecutive words of an item; an item of fewer words is one window;
    one without words has none. Null text has no words. An item without an id is
    searched for, but not listed. With no items, nothing is hit. Repeated items
    and rows count as themselves. Texts are read whole, however long; an empty table gives
    no rows. Columns of these names are replaced.

    Items are sent to the tasks, up to `block_bytes` of text at a time. A larger
    benchmark takes a round for each block: hits of the blocks are then joined.
    """
    spark = docs.sparkSession
    named = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))
    result = None
    for block in _blocks(named, block_bytes):
        sent = spark.sparkContext.broadcast((f"{id(block)}-{hash(tuple(block))}", block))

        def built_for(sent=sent, window=window):
            key, rows = sent.value
            return once("benchmark", (key, window), lambda: automaton(rows, window))

        if result is None:
            result = add_from_text(docs, text, RESULT, _compute(built_for))
        else:
            names = ["n_words", "n_hit", "hits", "item_ids", "contaminated"]
            held = scratch(result.withColumn("__before", F.struct(*names)), "benchmark-round")
            result = _joined(add_from_text(held, text, RESULT, _compute(built_for)), text)
    return result


def _joined(found: DataFrame, text: str) -> DataFrame:
    """The hits of a round and those of the rounds before as one."""
    ranges = F.array_sort(F.concat("__before.hits", "hits"))
    merged = F.aggregate(
        ranges,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        # ranges of hit words join where no word lies between them
        lambda done, x: F.when((F.size(done) > 0) & (x.start <= F.try_element_at(done, F.lit(-1)).end),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(done, F.lit(-1)).start.alias("start"),
                    F.greatest(F.try_element_at(done, F.lit(-1)).end, x.end).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = F.aggregate(
        F.col("__merged"), F.lit(0).cast("bigint"),
        lambda n, x: n + F.regexp_count(F.substring(lowered, x.start.cast("int") + 1, (x.end - x.start).cast("int")), F.lit(word)),
    )
    return drop_clashing(
        found.withColumn("__merged", merged)
        .withColumn("n_hit", count.cast("bigint"))
        .withColumn("hits", F.col("__merged"))
        .withColumn("item_ids", F.array_sort(F.array_union("__before.item_ids", "item_ids")))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))),
        ["__merged", "__before"],
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    found = find_benchmark(docs.withColumn("__row", F.struct("*")), benchmark, text, **options)
    return found.filter(~F.col("contaminated")).select("__row.*")

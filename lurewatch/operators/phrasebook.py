"""Wording rules from a table of phrases of any size.

Phrases are rows, not constants of the plan. Each is indexed by one piece of it, the
q-gram that the fewest phrases hold; a text gives those of its distinct q-grams that
may be in the index, an equi-join proposes phrases, and only those are looked for in the
text. Phrases shorter than a q-gram are indexed whole, beside texts' pieces of their
lengths. Pieces are bytes and travel as numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lurewatch.functions.arrays import join_splittable
from lurewatch.operators.content import with_searchable_text
from lurewatch.rules import RuleSet

#: Bytes of a piece.
GRAM = 6
#: Bits of the map that tells which pieces of a length may be in the index: 2 MB, whatever the tables hold.
MAP_BITS = 24
#: Pieces of a text that are worked on at once.
AT_ONCE = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
SIGNALS = "array<struct<key:string,severity:string,phrases:array<string>>>"


def phrase_table(spark, rules: RuleSet) -> DataFrame:
    """The phrases of a rule set as rows: (group_no, key, severity, phrase_no, phrase)."""
    rows = [(i, g.key, g.severity, k, p) for i, g in enumerate(rules.signals) for k, p in enumerate(g.phrases)]
    return spark.createDataFrame(rows, "group_no int, key string, severity string, phrase_no int, phrase string")


def grams(text: bytes, size: int) -> Iterator[np.ndarray]:
    """All pieces of a text of this length, some at a time, as numbers that differ between lengths too; none of a shorter one."""
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw) - size + 1, AT_ONCE):
        part = raw[at : at + AT_ONCE + size - 1].astype(np.int64)
        n = len(part) - size + 1
        found = np.full(n, size, np.int64)
        for i in range(size):
            found = found << 8 | part[i : i + n]
        yield found


def _places(found: np.ndarray) -> np.ndarray:
    return (found.view(np.uint64) * MIX >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def index(phrases: DataFrame) -> DataFrame:
    """(gram, low, size, place): each distinct lower-case phrase under the piece of it that the fewest phrases hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in batch.column(0).to_pylist():
                raw = low.encode("utf-8", "surrogatepass")
                size = min(len(raw), GRAM)
                found = np.unique(np.concatenate(list(grams(raw, size))))
                n = len(found)
                columns = [pa.array([low] * n, pa.string()), pa.array(found), pa.array([size] * n, pa.int32()), pa.array(_places(found))]
                yield pa.RecordBatch.from_arrays(columns, names=["low", "gram", "size", "place"])

    lower = phrases.select(F.lower("phrase").alias("low")).filter("low <> ''").distinct()
    pieces = lower.mapInArrow(run, "low string, gram bigint, size int, place bigint")
    often = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    best = pieces.join(often, "gram").groupBy("low").agg(F.min(F.struct("n", "gram", "size", "place")).alias("best"))
    return best.select("best.gram", "low", "best.size", "best.place")


def _maps(table: DataFrame) -> dict[int, np.ndarray]:
    """For each length of indexed pieces a bit map of their places."""
    place = F.col("place") + 1
    blocks = table.groupBy("size", F.bitmap_bucket_number(place).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    maps: dict[int, np.ndarray] = {}
    # no more rows than a map has blocks
    for r in blocks.collect():
        bits = np.frombuffer(r.bits, np.uint8)
        at = (r.block - 1) * len(bits)
        maps.setdefault(r.size, np.zeros((1 << MAP_BITS) // 8, np.uint8))[at : at + len(bits)] = bits
    return maps


def held_grams(texts: DataFrame, table: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram): the distinct pieces of each text that may be in the index; all that are, and few others."""
    sent = texts.sparkSession.sparkContext.broadcast(_maps(table))
    kept = texts.select(F.col(key), F.col(text))

    def likely(raw: bytes) -> np.ndarray:
        some = [np.zeros(0, np.int64)]
        for size, bits in sent.value.items():
            for found in grams(raw, size):
                place = _places(found)
                some.append(np.unique(found[(bits[place >> 3] >> (place & 7) & 1).astype(bool)]))
        return np.unique(np.concatenate(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [likely(x.as_buffer()) if x.is_valid else np.zeros(0, np.int64) for x in batch.column(1)]
            if found:
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), list(map(len, found)))))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(found))], names=[key, "gram"])

    return kept.mapInArrow(run, T.StructType([kept.schema.fields[0], T.StructField("gram", T.LongType())]))


def found_phrases(texts: DataFrame, phrases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, low): which lower-case phrases occur in each text; `text` is lower case, `key` tells rows apart.

    A gram that many texts hold is met by an exchange made for the join, which adaptive
    execution can split. The texts themselves go to the phrases once, by key.
    """
    table = index(phrases)
    held = held_grams(texts, table, key, text)
    proposed = join_splittable(held, table.select("gram", "low"), "gram").filter("low IS NOT NULL").select(key, "low").distinct()
    meant = join_splittable(proposed, texts.select(key, text), key)
    return meant.filter(F.col(text).contains(F.col("low"))).select(key, "low")


def with_signals(mail: DataFrame, phrases: DataFrame, key: str = "email_id") -> DataFrame:
    """Adds `searchable` and `signals` as `content.with_signals` does, from a table like `phrase_table`'s.

    `key` tells mails apart. Phrases of a group are shown as written, in their order.
    """
    mail = with_searchable_text(mail)
    hits = found_phrases(mail, phrases, key, "searchable")
    named = join_splittable(hits, phrases.withColumn("low", F.lower("phrase")), "low")
    groups = named.groupBy(key, "group_no", "key", "severity").agg(
        F.array_sort(F.collect_list(F.struct("phrase_no", "phrase", "low"))).alias("all")
    )
    # of phrases that differ in case the first counts
    alike = F.filter("all", lambda p, i: ~F.exists(F.slice("all", F.lit(1), i), lambda q: q["low"] == p["low"]))
    shown = F.transform(alike, lambda p: p["phrase"])
    signal = F.struct("group_no", F.col("key").alias("key"), "severity", shown.alias("phrases"))
    per_mail = groups.groupBy(F.col(key).alias("_mail")).agg(F.array_sort(F.collect_list(signal)).alias("_groups"))
    plain = F.transform("_groups", lambda g: F.struct(g["key"].alias("key"), g["severity"].alias("severity"), g["phrases"].alias("phrases")))
    joined = mail.join(per_mail, F.col(key) == F.col("_mail"), "left")
    return joined.withColumn("signals", F.coalesce(plain, F.array().cast(SIGNALS)).cast(SIGNALS)).drop("_mail", "_groups")

"""Alignment of two tokenizers: where their tokens of one text end together, and which ids link there.

Both tokenizers read the same bytes, a space and the text. The cumulative ends of a
text's tokens are the keys of one dictionary per tokenizer, end to index; the keys
both have, sorted, slice both id lists into groups. The last tokens of a group end
together: they are a link. An id pair's count says how many links of the whole
corpus hold it.

Of two tokens that end together the bytes of one end the bytes of the other. So only
as many pairs can be linked as the vocabularies have such endings, fewer than they
have bytes (324,300 for the public ones). That bounds the table of counts, whatever
the corpus: a task adds up a cell per pair, and the sums go to all tasks.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T

from lurewatch.llm.common import drop_clashing, once, slices
from lurewatch.llm.pieces import PieceTable, grouped, word_starts
from lurewatch.llm.tokenfile import _byte_letters

#: Characters of texts that are aligned together, unless one text is longer.
TOGETHER = 1 << 20
FIELDS = "n_a bigint, n_b bigint, n_groups bigint, groups {groups}, pairs array<int>, pair_links array<bigint>"
GROUPS = {False: "array<struct<a:array<int>,b:array<int>>>", True: "string"}


class ByteTokens:
    """Byte-level BPE from a tokenizers file with the public pattern; added tokens' strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        letters = _byte_letters()
        back = {chr(code): byte for byte, code in letters.items()}
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes(back[c] for c in entry)
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        model = Tokenizer.from_file(path).model
        self.table = PieceTable(lambda new: [[t.id for t in model.tokenize(p.decode("latin-1").translate(letters))] for p in new])

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        return self.table.ids_of(texts)


class PieceTokens:
    """A sentencepiece model with byte fallback, which adds a leading space itself.

    No piece of it has a space after another sign, so words are encoded one by one, and
    once as long as they are remembered.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path}: a piece spans words")
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        space = [model.piece_to_id("▁")]

        def encode(words: list[bytes]) -> list[list[int]]:
            found = model.encode([w[1:].decode() for w in words], num_threads=1)
            return [space if w == b" " else ids for w, ids in zip(words, found)]

        self.table = PieceTable(encode, word_starts)

    def ids_of(self, spaced: list[str]) -> list[np.ndarray]:
        """The ids of texts that are given with the space the model adds."""
        return self.table.ids_of(spaced)


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted codes `a's id * len(b) + b's id` of all pairs that can end together: one ends the other."""
    by_bytes: tuple[dict[bytes, list[int]], dict[bytes, list[int]]] = defaultdict(list), defaultdict(list)
    for table, tokens in zip(by_bytes, (a, b)):
        for i, token in enumerate(tokens):
            table[token].append(i)
    found = {
        i * len(b) + j for i, token in enumerate(a) for k in range(len(token)) for j in by_bytes[1].get(token[k:], ())
    }
    found.update(i * len(b) + j for j, token in enumerate(b) for k in range(len(token)) for i in by_bytes[0].get(token[k:], ()))
    return np.array(sorted(found), np.int64)


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokens(byte_path), PieceTokens(piece_path)
        self.codes = possible_pairs(self.a.bytes, self.b.bytes)
        self.flat = [(np.frombuffer(b"".join(t.bytes), np.uint8), np.cumsum(t.sizes) - t.sizes, t.sizes) for t in (self.a, self.b)]

    def ids_of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both id lists of each text; empty where the bytes of either are not those of a space and the text."""
        spaced = [" " + t for t in texts]
        raws = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in spaced]
        sides = []
        for tokens, flat in ((self.a, self.flat[0]), (self.b, self.flat[1])):
            ids = tokens.ids_of(spaced)
            sides.append((ids, [len(raw) > 1 and same_bytes(x, raw, *flat) for x, raw in zip(ids, raws)]))
        none = np.zeros(0, np.uint32)
        return [(x, y) if good and right else (none, none) for x, y, good, right in zip(sides[0][0], sides[1][0], sides[0][1], sides[1][1])]

    def rows(self, texts: list[str], written: bool = False) -> list[pa.Array]:
        """The FIELDS of each text, groups as lists or written out."""
        both = self.ids_of(texts)
        ids, ends = zip(*((np.concatenate([b[k] for b in both]), np.cumsum([len(b[k]) for b in both])) for k in (0, 1)))
        lasts = [cuts(*(np.cumsum(t.sizes[x]).tolist() for t, x in zip((self.a, self.b), b))) for b in both]
        before = [e - np.diff(e, prepend=0) for e in ends]
        cut = [np.concatenate([last[k] + at for last, at in zip(lasts, before[k].tolist())]) for k in (0, 1)]
        n_groups = np.array([len(last[0]) for last in lasts])
        linked = ids[0][cut[0] - 1].astype(np.int64) * len(self.b.bytes) + ids[1][cut[1] - 1]
        row = np.repeat(np.arange(len(texts)), n_groups) * len(self.codes)
        distinct, times = np.unique(row + np.searchsorted(self.codes, linked), return_counts=True)
        offsets = pa.array(np.searchsorted(distinct, np.arange(len(texts) + 1) * len(self.codes)).astype(np.int32))
        starts = np.concatenate(([0], np.cumsum(n_groups))).astype(np.int32)
        if written:
            groups = written_groups(ids, cut, np.stack(ends), max(len(self.a.bytes), len(self.b.bytes)))
        else:
            sides = [
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], c)).astype(np.int32)), pa.array(x.view(np.int32)))
                for c, x in zip(cut, ids)
            ]
            groups = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(sides, names=["a", "b"]))
        return [
            *[pa.array(np.diff(e, prepend=0), pa.int64()) for e in ends], pa.array(n_groups, pa.int64()), groups,
            pa.ListArray.from_arrays(offsets, pa.array((distinct % len(self.codes)).astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
        ]


def written_groups(ids: list[np.ndarray], cut: list[np.ndarray], ends: np.ndarray, size: int) -> pa.Array:
    """The groups of each text as `a1,a2|b1;a3|b2,b3`.

    ids: of all texts, per side, below `size`; cut: where each group ends in them; ends: where each text does.
    """
    sizes = [np.diff(c, prepend=0) for c in cut]
    if not len(cut[0]):
        return pa.array([""] * ends.shape[1])
    total = len(ids[0]) + len(ids[1])
    order, after = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    # the ids of a side stand behind all earlier groups of the other; those of b behind their own group's a too
    places = (
        np.arange(len(ids[0])) + np.repeat(cut[1] - sizes[1], sizes[0]), np.arange(len(ids[1])) + np.repeat(cut[0], sizes[1]),
    )
    for place, x, c, sign in zip(places, ids, cut, "|;"):
        order[place] = x
        after[place[c - 1]] = ord(sign)
    digits, begins, widths = once("decimals", size, lambda: _decimals(size))
    width = widths[order] + 1  # and the sign
    last = np.cumsum(width)
    held = digits[np.arange(int(last[-1])) + np.repeat(begins[order] - (last - width), width)]
    held[last - 1] = after
    bounds = np.concatenate(([0], last))[np.concatenate(([0], ends.sum(axis=0)))]
    # without the sign after a text's last id
    raw = held.tobytes()
    return pa.array([raw[a : b - 1].decode() if b > a else "" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digits of the numbers below `size`, each with room for a sign; where they begin, and how many they are."""
    texts = [b"%d " % i for i in range(size)]
    widths = np.array(list(map(len, texts)))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(widths) - widths, widths - 1


def same_bytes(ids: np.ndarray, raw: np.ndarray, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether the tokens' bytes, joined, are `raw`."""
    size = sizes[ids]
    if int(size.sum()) != len(raw):
        return False
    return bool(np.array_equal(flat[np.arange(len(raw)) + np.repeat(begins[ids] - (np.cumsum(size) - size), size)], raw))


def cuts(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each list end at or before each common end."""
    at_a, at_b = dict(zip(ends_a, count(1))), dict(zip(ends_b, count(1)))
    common = sorted(at_a.keys() & at_b.keys())
    return tuple(np.array(list(map(at.__getitem__, common)), np.int64) for at in (at_a, at_b))


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", written: bool = False) -> DataFrame:
    """The documents with both tokenizers' tokens of their text, in groups that end together.

    Adds `n_a` and `n_b`, the number of tokens; `n_groups`; `groups`, the ids of each group, those
    of the byte-level tokenizer (a) and of the piece tokenizer (b), or with `written` as
    text, `a1,a2|b1;a3|b2,b3`; `pairs`, the numbers
    of the id pairs linked in the text (see `pair_ids`), and `pair_links`, how often each is.
    The last ids of a group are its link: every token has bytes, so no other two tokens
    of a group end together.

    Null and empty texts, and texts that one of the tokenizers changes (white space
    of its own, signs it normalizes), have no tokens, groups or links. Texts are
    encoded whole, however long; a text that repeats is counted as often as it is
    there. An empty table gives no rows. A column with the name of a result is replaced.
    """
    added = T._parse_datatype_string(FIELDS.format(groups=GROUPS[written]))
    kept = drop_clashing(docs, [n for n in added.names if n.lower() != text.lower()])
    column = next(i for i, c in enumerate(kept.columns) if c.lower() == text.lower())
    names = [*kept.columns, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = once("aligner", (byte_path, piece_path), lambda: Aligner(byte_path, piece_path))
        for batch in slices(batches):
            at = 0
            for some in grouped(batch.column(column).to_pylist(), TOGETHER):
                rows = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays([*rows.columns, *aligner.rows(some, written)], names=names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added.fields]))


def pair_ids(byte_path: str, piece_path: str) -> np.ndarray:
    """The ids (a, b) of each pair number: one row per pair that can be linked at all."""
    a, b = ByteTokens(byte_path), PieceTokens(piece_path)
    codes = possible_pairs(a.bytes, b.bytes)
    return np.stack((codes // len(b.bytes), codes % len(b.bytes)), axis=1)


def pair_counts(aligned: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links of all rows hold each pair. A task hands on one row per pair at most."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            pairs, links = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            np.add.at(total, pairs, links)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    sums = aligned.select("pairs", "pair_links").mapInArrow(add_up, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    total = np.zeros(n_pairs, np.int64)
    for row in sums.collect():  # no more than n_pairs rows
        total[row.pair] = row.n
    return total


def add_link_counts(aligned: DataFrame, ids: np.ndarray) -> DataFrame:
    """Adds `n_best` and `count_sum` to rows of `align`, which should be a stored table: it is read twice.

    `count_sum` adds up the counts of a row's links; `n_best` is the number of its links whose
    count is the highest that their b has with any a, ties included. Both are 0
    without links. `ids` is what `pair_ids` gives.
    """
    total = pair_counts(aligned, len(ids))
    highest = np.zeros(int(ids[:, 1].max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, ids[:, 1], total)
    sent = aligned.sparkSession.sparkContext.broadcast((total, total == highest[ids[:, 1]]))
    kept = drop_clashing(aligned, ["n_best", "count_sum"])
    places = [kept.columns.index(c) for c in ("pairs", "pair_links")]
    names = [*kept.columns, "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = sent.value
        for batch in batches:
            pairs, links = (batch.column(i).flatten().to_numpy() for i in places)
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(batch.column(places[0])), np.int64))
            results = []
            for values in (links * best[pairs], links * counts[pairs]):
                sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(values)))[ends]
                results.append(pa.array(np.diff(sums, prepend=0), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *results], names=names)

    fields = T._parse_datatype_string("n_best bigint, count_sum bigint").fields
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))

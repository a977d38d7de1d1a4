"""Cross-tokenizer alignment against a plain version: offsets of all tokens, compared pair by pair."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from conftest import SMALL
from lurewatch.llm import align, bpe, catalog

PATHS = bpe.public_path("byte_bpe_50k.json"), bpe.public_path("piece_bpe_32k.model")
SIGNS = [*"abc the ing 1", " ", "  ", "\n", "\t", "é", "▁", "ﬁ", "中", "\0", "<|endoftext|>", "</s>", "<0x41>", "…", "é"]


def byte_decoder() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Plain:
    """Both libraries, called on whole texts; token bytes by the rule of the contract."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        letters = byte_decoder()
        vocabulary = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"]
        self.entry = {i: bytes(letters[c] for c in e) for e, i in vocabulary.items()}

    def piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text: str | None):
        """(id, end) of all tokens of both, or none."""
        whole = (" " + (text or "")).encode()
        found = []
        for ids, name in ((self.a.encode(" " + (text or ""), add_special_tokens=False).ids, self.entry.__getitem__), (self.b.encode(text or ""), self.piece)):
            end, listed = 0, []
            if b"".join(map(name, ids)) != whole or not text:
                return [], []
            for i in ids:
                end += len(name(i))
                listed.append((i, end))
            found.append(listed)
        return found

    def links(self, text: str | None) -> list[tuple[int, int]]:
        one, other = self.tokens(text)
        return [(a, b) for a, end in one for b, last in other if end == last]

    def groups(self, text: str | None) -> str:
        one, other = self.tokens(text)
        begin, parts = 0, []
        for cut in sorted({e for _, e in one} & {e for _, e in other}):
            parts.append("|".join(",".join(str(i) for i, e in side if begin < e <= cut) for side in (one, other)))
            begin = cut
        return ";".join(parts)


def expected(texts: dict[int, str | None]) -> dict[int, tuple]:
    plain = Plain()
    links = {i: plain.links(t) for i, t in texts.items()}
    counts = Counter(x for found in links.values() for x in found)
    best: Counter = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = {}
    for i, text in texts.items():
        one, other = plain.tokens(text)
        listed = plain.groups(text)
        rows[i] = (
            len(one), len(other), listed.count(";") + 1 if listed else 0, len(links[i]),
            sum(counts[x] == best[x[1]] for x in links[i]), sum(counts[x] for x in links[i]),
            hashlib.sha256(listed.encode()).hexdigest() if listed else "",
        )
    return rows


def query_rows(spark, folder) -> list[tuple]:
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return [tuple(r[c] for c in columns) for r in catalog.queries()["op11_align"](spark, str(folder)).collect()]


def test_alignment_equals_brute_force(spark, tmp_path):
    texts = {r["doc_id"]: r["text"][:1500] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist() if r["text"]}
    texts |= {
        10**6: None, 10**6 + 1: "", 10**6 + 2: " ", 10**6 + 3: "a ▁ b", 10**6 + 4: "</s> <|endoftext|> <0x41> <unk>",
        10**6 + 5: "ﬁne print　é", 10**6 + 6: "\0\x01 中文 \U0001d4b3", 10**6 + 7: "same", 10**6 + 8: "same",
        10**6 + 9: "word " * 400 + "x" * 900,
    }
    schema = "doc_id bigint, text string, groups string, Pairs int"
    spark.createDataFrame([(i, t, "g", 1) for i, t in texts.items()], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r[0]: r[1:] for r in query_rows(spark, tmp_path)} == expected(texts)


def test_groups_are_real_outputs(spark):
    docs = spark.createDataFrame([(1, "un lieu", 7, "x")], "doc_id int, text string, N_A int, source string")
    row = align.align(docs, *PATHS).collect()[0]
    plain = Plain()
    assert ";".join("|".join(",".join(map(str, side)) for side in g) for g in row.groups) == plain.groups("un lieu")
    ids = align.pair_ids(*PATHS)
    assert sorted(tuple(ids[p].tolist()) for p, n in zip(row.pairs, row.pair_links) for _ in range(n)) == sorted(plain.links("un lieu"))
    assert row.n_a == len(plain.tokens("un lieu")[0]) and row.source == "x"


def test_an_empty_table_has_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert query_rows(spark, tmp_path) == []


def test_a_row_without_an_id_and_repeated_rows(spark, tmp_path):
    rows = [(None, "a text"), (3, "a text"), (3, "a text"), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = query_rows(spark, tmp_path)
    assert sorted(str(r[0]) for r in found) == ["3", "3", "4", "None"]
    links = len(Plain().links("a text"))
    assert {r[6] for r in found if r[4]} == {3 * links} and all(r[4] == links for r in found if r[0] != 4)


ONCE: dict[str, object] = {}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=30).map("".join), max_size=4))
def test_any_text_has_the_groups_of_its_offsets(texts):
    plain = ONCE.setdefault("plain", None) or ONCE.update(plain=Plain(), own=align.Aligner(*PATHS)) or ONCE["plain"]
    own = ONCE["own"]
    for text, (one, other) in zip(texts, own.ids_of(texts)):
        want = plain.tokens(text)
        assert (list(one), list(other)) == tuple([i for i, _ in side] for side in want)
    if texts:
        rows = own.rows(texts)
        assert own.rows(texts, written=True)[3].to_pylist() == [plain.groups(t) for t in texts]
        for text, groups in zip(texts, rows[3].to_pylist()):
            assert ";".join("|".join(",".join(map(str, g[k])) for k in "ab") for g in groups) == plain.groups(text)

"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at `distance` or fewer differing bits; documents are
grouped by the links they can be reached through. Exact copies collapse to one
fingerprint first, so a hot group of copies costs one row.

Finding links: the bits are put in partitions, correlated bits together. If
partition i gets `u_i` units with sum(u_i) = distance + 1, then any two linked
fingerprints differ by at most `u_i - 1` bits in some partition that has units:
otherwise they would differ by distance + 1 bits or more. How many partitions,
and how many units each gets, is chosen by dynamic programming over the estimated
number of probes and candidates. A partition of one unit is looked up exactly; of
u units, also with up to u - 1 of its bits flipped. Every candidate is verified on
all 64 bits. Large buckets are split into blocks, and each pair of blocks is a
group of its own: nothing grows beyond two blocks, and no link is lost. A group
hands on a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.llm.common import add_from_text, drop_clashing, id_text, scratch

BITS = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
HASHES_AT_ONCE = 1 << 16
#: Rows of a bucket that are compared at once; larger buckets are split.
BLOCK_ROWS = 512
#: Cost of a verified candidate, in units of a shuffled probe row.
CANDIDATE_COST = 0.01


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of a text; 0 for null, empty and blank text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    size = min(words, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        part = slice(at, at + HASHES_AT_ONCE)
        spans = zip(starts[part], ends[part])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    over = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(over.view("<u8")[0])


def add_fingerprint(docs: DataFrame, text: str = "text", words: int = 3, output: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a signed long; null text counts as empty."""

    def compute():
        return lambda texts: [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

    return add_from_text(docs, text, f"`{output}` bigint", compute)


# --- choice of partitions and thresholds --------------------------------------


def bit_moments(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are set together (64 x 64).

    Every task adds up its own rows, so what reaches the driver does not grow.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(hashes), HASHES_AT_ONCE):
                some = np.ascontiguousarray(hashes[at : at + HASHES_AT_ONCE])
                bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        cells = np.arange(BITS * BITS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], names=["cell", "n"])

    sums = distinct.select("fingerprint").mapInArrow(add_up, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    matrix = np.zeros(BITS * BITS)
    for row in sums.collect():
        matrix[row.cell] = row.n
    return distinct.count(), matrix.reshape(BITS, BITS)


def correlated_groups(correlation: np.ndarray, groups: int) -> list[list[int]]:
    """Bits dealt to groups of nearly equal size, each next bit the one most correlated with its group."""
    left = set(range(BITS))
    strength = np.abs(correlation)
    dealt = []
    for k in range(groups):
        size = len(left) // (groups - k)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (strength[b, rest].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        dealt.append(sorted(group))
    return dealt


def share_within(group: list[int], rates: np.ndarray, correlation: np.ndarray, radius: int) -> float:
    """Estimated share of pairs that differ by at most `radius` bits in a group.

    Correlated bits count as fewer: as many as the participation ratio of their
    correlation matrix, each differing at the group's mean rate.
    """
    eigen = np.clip(np.linalg.eigvalsh(correlation[np.ix_(group, group)]), 0, None)
    effective = max(1.0, eigen.sum() ** 2 / max((eigen**2).sum(), 1e-12))
    differ = float(np.clip(np.mean(2 * rates[group] * (1 - rates[group])), 1e-6, 0.5))
    same = (1 - differ) ** effective
    return min(1.0, sum(same * comb(round(effective), r) * (differ / (1 - differ)) ** r for r in range(radius + 1)))


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Units per partition with the least total cost; costs[i][u] is partition i's cost at u units."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * units
    for cost in costs:
        nxt: list[tuple[float, list[int]] | None] = [None] * (units + 1)
        for used, state in enumerate(best):
            if state is None:
                continue
            for u in range(min(units - used, len(cost) - 1) + 1):
                total = state[0] + cost[u]
                if nxt[used + u] is None or total < nxt[used + u][0]:
                    nxt[used + u] = (total, [*state[1], u])
        best = nxt
    assert best[units] is not None
    return best[units]


def plan(count: int, together: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """The partitions to look up: their bits and the largest distance within each."""
    # no fewer than a pair, or all plans would cost nothing
    count = max(count, 2)
    rates = np.diag(together) / count
    spread = np.sqrt(np.clip(rates * (1 - rates), 1e-9, None))
    correlation = (together / count - np.outer(rates, rates)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 1)
    units = distance + 1
    choices = []
    for groups in range(1, min(2 * units, BITS) + 1):
        dealt = correlated_groups(correlation, groups)
        costs = []
        for group in dealt:
            cost = [0.0]
            for radius in range(min(distance, len(group)) + 1):
                probes = 1 + sum(comb(len(group), r) for r in range(1, radius + 1)) / 2
                pairs = count * count / 2 * share_within(group, rates, correlation, radius)
                cost.append(count * probes + CANDIDATE_COST * pairs)
            costs.append(cost)
        if sum(len(c) - 1 for c in costs) >= units:
            total, given = allocate(costs, units)
            choices.append((total, groups, [(g, u - 1) for g, u in zip(dealt, given) if u]))
    return min(choices, key=lambda c: c[:2])[2]


# --- probing and verifying ------------------------------------------------------


def _flips(group: list[int], radius: int) -> list[tuple[int, int]]:
    """(mask to flip, its highest bit), as signed longs."""
    found = []
    for r in range(1, radius + 1):
        for bits in combinations(group, r):
            mask = sum(1 << b for b in bits)
            top = 1 << max(bits)
            found.append(tuple(m - (1 << 64) if m >> 63 else m for m in (mask, top)))
    return found


def _looked_up(partition: int, group: list[int], radius: int) -> Column:
    """The rows a fingerprint has in one partition: its own key, and keys with flipped bits.

    Of two fingerprints that differ in the partition, only the one whose highest
    differing bit is 0 probes for the other.
    """
    mask = sum(1 << b for b in group)
    mask -= (1 << 64) if mask >> 63 else 0
    own = F.col("fingerprint").bitwiseAND(F.lit(mask))
    rows = F.array(F.struct(F.lit(partition).alias("part"), own.alias("key"), F.lit(False).alias("probe")))
    flips = _flips(group, radius)
    if not flips:
        return rows
    masks = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(t).alias("t")) for m, t in flips])
    upward = F.filter(masks, lambda x: own.bitwiseAND(x.t) == 0)
    probes = F.transform(
        upward, lambda x: F.struct(F.lit(partition).alias("part"), own.bitwiseXOR(x.m).alias("key"), F.lit(True).alias("probe"))
    )
    return F.concat(rows, probes)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _forest(groups: np.ndarray, prints: np.ndarray, probe: np.ndarray, side: np.ndarray, cross: np.ndarray, distance: int):
    """Links of a spanning forest within each run of equal `groups`: (fingerprint, its root's)."""
    n = len(groups)
    parent = np.arange(n)
    active = np.arange(n)
    lag = 0
    while len(active):
        lag += 1
        active = active[active + lag < n]
        active = active[groups[active] == groups[active + lag]]
        if not len(active):
            break
        other = active + lag
        ask = ~(probe[active] & probe[other]) & ~(cross[active] & (side[active] == side[other])) & (parent[active] != parent[other])
        a, b = active[ask], other[ask]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= distance
        a, b = a[near], b[near]
        if len(a):
            for x, y in zip(a.tolist(), b.tolist()):
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                if x != y:
                    parent[max(x, y)] = min(x, y)
            parent = _roots(parent)
    child = np.flatnonzero((parent != np.arange(n)) & (prints != prints[parent]))
    return prints[child], prints[parent[child]]


def links(distinct: DataFrame, partitions: list[tuple[list[int], int]], distance: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that are within `distance`."""
    rows = distinct.select(
        "fingerprint", F.explode(F.concat(*[_looked_up(i, g, r) for i, (g, r) in enumerate(partitions)])).alias("x")
    ).select("fingerprint", "x.part", "x.key", "x.probe")
    large = rows.groupBy("part", "key").count().filter(F.col("count") > block_rows)
    large = scratch(large.select("part", "key", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")), "simhash-large")
    spread = rows.join(large, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    spread = spread.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = spread.select(
        "part", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
        "mine", "fingerprint", "probe",
    )
    keys = ["part", "key", "low", "high"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def forest(table: pa.Table) -> pa.RecordBatch:
            part, key, low, high, mine, prints, probe = (c.to_numpy() for c in table.columns)
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            a, b = _forest(np.cumsum(new), prints.view(np.uint64), probe, mine, low != high, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not len(held):
                continue
            last = held.slice(len(held) - 1)
            same = np.ones(len(held), bool)
            for name in keys:
                same &= held[name].to_numpy() == last[name][0].as_py()
            cut = len(held) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield forest(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield forest(held)

    return dealt.mapInArrow(verify, "a bigint, b bigint").distinct()


# --- components -------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node reachable.

    Alternates large-star and small-star until only stars are left. Minima are
    aggregated before they are shuffled, and are written, so that joins on a hot
    root can be split.
    """
    edges = scratch(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct(), "links"
    )
    while not _is_star_forest(edges):
        both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = scratch(both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("u"), F.least("v", "m").alias("m")), "large-star")
        large = scratch(edges.join(least, "u").select("v", F.col("m").alias("u")).filter("u < v").distinct(), "large-star-links")
        least = scratch(large.groupBy("v").agg(F.min("u").alias("m")), "small-star")
        # all smaller neighbours of v, and v itself, point to the smallest of them
        edges = scratch(
            large.join(least, "v").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select("x.v", F.col("x.m").alias("u")).filter("u < v").distinct(),
            "small-star-links",
        )
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, and no such smaller node has one itself."""
    many = edges.groupBy("v").count().filter("count > 1").select("v")
    inner = edges.select("v").join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return many.unionAll(inner).isEmpty()


def group_of_prints(distinct: DataFrame, distance: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(fingerprint, root): fingerprints that have links, and the least fingerprint they reach."""
    count, together = bit_moments(distinct)
    found = links(distinct, plan(count, together, distance), distance, block_rows)
    return components(found).select(F.col("node").alias("fingerprint"), "root")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per document: its id, `text_hash`, `fingerprint` (signed long), `root`, `component_id`.

    `component_id` is the smallest id reachable over links, the document's own
    included; null if none of them has an id. Null, empty and blank texts have
    fingerprint 0 and link like any other. Repeated rows come back as often as
    they are there. Extra columns are ignored; an empty table gives no rows.
    `root` tells groups apart also where ids are null; `text_hash` tells apart
    rows that share an id.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    prints = scratch(add_fingerprint(named, "text", words).drop("text"), "simhash-prints")
    distinct = scratch(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = scratch(group_of_prints(distinct.select("fingerprint"), distance, block_rows), "simhash-roots")
    rooted = distinct.join(roots, "fingerprint", "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = scratch(rooted, "simhash-rooted")
    least = scratch(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-components")
    whole = scratch(rooted.join(least, "root").select("fingerprint", "root", "component_id"), "simhash-groups")
    return prints.join(whole, "fingerprint").select("doc_id", "text_hash", "fingerprint", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without near-duplicates: of each group the one with the smallest id stays.

    Among rows of the same id (or all without one) the one with the smallest hash
    of its text stays, once. Columns stay as they are.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("kept")
    kept = found.groupBy("root").agg(first).select(F.coalesce(F.col("kept.doc_id").cast("string"), F.lit("")).alias("__id"), F.col("kept.text_hash").alias("__text"))
    kept = scratch(kept.distinct(), "simhash-kept")
    marked = docs.withColumns({"__id": id_text(doc_id), "__text": F.xxhash64(F.col(text))})
    return drop_clashing(marked.join(kept, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"]), ["__id", "__text"])

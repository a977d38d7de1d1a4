"""MinHash near-duplicates: one-permutation hashing, bands, and star-shaped candidate edges.

A document's set is that of its word shingles, each a 64-bit hash. One hash per
shingle fills all bins of a signature: the top bits choose the bin, the least value
of a bin is its minimum. An empty bin takes the value of a filled one, chosen at
random, evenly and alike in all documents (optimal densification). Sets that agree
in all bins of a band meet in a bucket. With 32 bands of 4 bins two sets of
similarity 0.8 miss every bucket once in 20 million times.

Equal sets collapse first. A set of which no other has enough shingles cannot link
and is left out. In a bucket one set is the hub, and only it is paired with the others, so
a bucket gives as many candidates as it has sets; all buckets prefer the same hubs, sets that share
the most buckets. Every candidate is confirmed on the full sets.

What a star cannot see is looked for in rounds: as long as a bucket holds more than one
component, further sets become centres, first those with the most links, then of many
times more each round until all have been, and are paired with sets of other components.
What each set lost and gained against its hub bounds what any two can have in common, so
copies that changed in different places are told apart without being paired. In the
end any two sets of a bucket have been compared, or cannot link, or are linked through others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from lurewatch.llm.common import add_from_text, id_text, scratch, slices
from lurewatch.llm.simhash import LOWER, components

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
SEED = 42
#: Bits of the map that tells tasks which rows to hand on: 8 MB.
BITMAP = 1 << 26
#: Bits of the map of shingles that a set has not but its hub has.
LOST_BITS = 256
#: Centres of a bucket grow by this factor from round to round.
MORE = 64
#: Components are found anew after a round whose links are at least one for so many members of open buckets.
ANEW = 100
#: Candidates whose sketches agree in fewer bins are no links: by chance bins agree one time in four, and of the
#: sketches of sets of similarity 0.8, which agree in 109 bins on average, one in a billion agrees in so few.
LEAST_AGREEMENT = 82
SHIFT = np.uint64(64 - (BINS - 1).bit_length())
EDGES = np.arange(BINS, dtype=np.uint64) << SHIFT
MIX = np.uint64(0x9E3779B97F4A7C15)


def _turns() -> np.ndarray:
    """For each bin, all bins in an order of its own: where it looks for a value while it is empty."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


TURNS = _turns()


def shingles(text: str | None, words: int = 4) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; with fewer words, the whole sequence as one."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    size = min(words, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist()))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)))


def signature(found: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty bin has that of the first filled one in its turn."""
    first = np.searchsorted(found, EDGES)
    filled = np.append(first[1:], len(found)) > first
    source = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    if len(empty):
        turns = TURNS[empty]
        source[empty] = turns[np.arange(len(empty)), filled[turns].argmax(axis=1)]
    return found[first[source]]


def buckets_of(values: np.ndarray) -> np.ndarray:
    """A number for each band: equal where all its bins are."""
    rows = values.reshape(BANDS, ROWS)
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for column in rows.T:
        mixed = (mixed ^ column) * MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed


def add_buckets(docs: DataFrame, text: str = "text", words: int = 4) -> DataFrame:
    """Adds `set_key` (16 bytes, equal for equal sets), `n_shingles`, `buckets` and `sketch` (two bits a bin).

    Null, empty and blank texts have no shingles, and null for the rest.
    """

    def compute():
        def work(texts: list[str | None]) -> list[pa.Array]:
            keys, sizes, numbers, sketches = [], [], [], []
            for found in (shingles(text, words) for text in texts):
                sizes.append(len(found))
                values = signature(found) if len(found) else None
                keys.append(None if values is None else set_key(found))
                numbers.append(None if values is None else buckets_of(values).view(np.int64))
                sketches.append(None if values is None else sketch(values))
            longs = pa.list_(pa.int64())
            return [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(numbers, longs), pa.array(sketches, longs)]

        return work

    return add_from_text(docs, text, "set_key binary, n_shingles bigint, buckets array<bigint>, sketch array<bigint>", compute)


def add_sets(docs: DataFrame, text: str = "text", words: int = 4) -> DataFrame:
    """Adds `set_key` and the full set as `shingles`, to texts that have any."""

    def compute():
        def work(texts: list[str | None]) -> list[pa.Array]:
            sets = [shingles(text, words) for text in texts]
            return [pa.array(map(set_key, sets), pa.binary()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())]

        return work

    return add_from_text(docs, text, "set_key binary, shingles binary", compute)


def sketch(values: np.ndarray) -> np.ndarray:
    """The two lowest bits of each bin, as longs."""
    pairs = np.stack((values & np.uint64(1), (values >> np.uint64(1)) & np.uint64(1)), axis=1).astype(np.uint8)
    return np.packbits(pairs.ravel(), bitorder="little").view("<i8")


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.astype("<u8").tobytes())


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    place = np.minimum(np.searchsorted(other, one), len(other) - 1)
    both = int((other[place] == one).sum())
    return 100 * both >= percent * (len(one) + len(other) - both)


def likely(rows: DataFrame, number: Column, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose `number` may be in a column of longs: all that are, and few others while that is short.

    A bitmap of BITMAP bits goes to the tasks, 8 MB whatever the tables hold; what it lets
    through is to be joined. So rows that are not wanted are not dealt out.
    """

    def place(value: Column) -> Column:
        return F.pmod(value, F.lit(BITMAP))

    blocks = wanted.select(place(F.col(column)).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__block"))
    blocks = scratch(blocks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits")), "minhash-bitmap")
    marked = rows.withColumn("__p", place(number)).withColumn("__block", F.bitmap_bucket_number("__p"))
    position = F.bitmap_bit_position("__p")
    byte = F.conv(F.hex(F.substr("__bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("getbit", byte, (position % 8).cast("int")) == 1
    # written, or the optimiser would put the later join first
    return scratch(marked.join(F.broadcast(blocks), "__block").filter(held).drop("__p", "__block", "__bits"), "minhash-likely")


def _with_sets(pairs: DataFrame, nodes: DataFrame, one: str, other: str) -> DataFrame:
    """Pairs of keys with the full sets of both."""
    ends = pairs.select(F.explode(F.array(one, other)).alias("set_key")).select(F.xxhash64("set_key").alias("node"))
    nodes = likely(nodes, F.xxhash64("set_key"), ends, "node")
    left, right = (nodes.select(F.col("set_key").alias(x), F.col("shingles").alias(f"of_{x}")) for x in (one, other))
    return pairs.join(left, one).join(right, other).select(one, other, f"of_{one}", f"of_{other}")


def confirmed(edges: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The candidates (a, b) that are links by the full sets of `nodes`."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = ([np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(i)] for i in (2, 3))
            near = pa.array([similar(x, y, percent) for x, y in zip(*sets)], pa.bool_())
            yield batch.select(["a", "b"]).filter(near)

    return scratch(_with_sets(edges, nodes, "a", "b").mapInArrow(check, "a binary, b binary"), "minhash-links")


def _differ(a: str, b: str) -> Column:
    """In how many bins two sketches (arrays of longs, two bits a bin) differ."""
    words = []
    for i in range(BINS // 32):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        words.append(F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))))
    return sum(words[1:], words[0])


def _members(distinct: DataFrame) -> DataFrame:
    """(bucket, key, n, sketch, turn, size) of all sets that share a bucket."""
    rows = scratch(distinct.select(F.explode("buckets").alias("bucket"), F.col("set_key").alias("key")), "minhash-rows")
    shared = scratch(rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "minhash-buckets")
    # most buckets hold one set: their rows are not dealt out again
    several = scratch(likely(rows, F.col("bucket"), shared, "bucket").join(shared, "bucket"), "minhash-several")
    turn = F.pmod(F.xxhash64("set_key"), F.lit(1 << 30)) / float(1 << 30)
    facts = distinct.select(F.col("set_key").alias("key"), F.col("n_shingles").alias("n"), "sketch", turn.alias("turn"))
    return scratch(several.join(facts, "key"), "minhash-members")


def compared(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of sets and their hubs (key, hub): whether they are `linked`; how many of the hub's shingles a set has `lost`,
    how many others it has `gained`, and in `bits` a map of the lost ones by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            linked, lost, gained, bits = [], [], [], []
            for x, h in zip(*([np.frombuffer(v.as_buffer(), "<u8") for v in batch.column(i)] for i in (2, 3))):
                place = np.minimum(np.searchsorted(x, h), len(x) - 1)
                gone = h[x[place] != h]
                both = len(h) - len(gone)
                linked.append(100 * both >= percent * (len(x) + len(gone)))
                lost.append(len(gone))
                gained.append(len(x) - both)
                held = np.zeros(LOST_BITS, np.uint8)
                held[(gone * MIX >> np.uint64(32)) % np.uint64(LOST_BITS)] = 1
                bits.append(np.packbits(held, bitorder="little").view("<i8"))
            longs = [pa.array(v, pa.int64()) for v in (lost, gained)]
            columns = [*batch.columns[:2], pa.array(linked, pa.bool_()), *longs, pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "hub", "linked", "lost", "gained", "bits"])

    fields = "key binary, hub binary, linked boolean, lost bigint, gained bigint, bits array<bigint>"
    return scratch(_with_sets(pairs, nodes, "key", "hub").mapInArrow(run, fields), "minhash-compared")


def _ones(bits: str) -> Column:
    return sum((F.bit_count(F.col(bits)[i]) for i in range(1, LOST_BITS // 64)), F.bit_count(F.col(bits)[0]))


def _shared_lost() -> Column:
    """At most how many shingles of their hub two sets both lack: bits they share, and what shares a bit within either (`twice`)."""
    both = [F.bit_count(F.col("bits")[i].bitwiseAND(F.col("c_bits")[i])) for i in range(LOST_BITS // 64)]
    return F.least(F.col("lost"), F.col("c_lost"), sum(both[1:], both[0]) + F.least("twice", "c_twice"))


def links(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between distinct sets that connect all sets of a bucket that are similar."""
    alive = _alive(members, nodes, percent)
    hubs = alive.groupBy("bucket").agg(F.max(F.struct("reach", "turn", "key", "n", "own", "sketch")).alias("h"), F.count("*").alias("left"))
    hubs = hubs.filter("left > 1").select(
        "bucket", "left", F.col("h.key").alias("hub"), *[F.col(f"h.{c}").alias(f"c_{c}") for c in ("n", "own", "sketch")]
    )
    state = scratch(alive.drop("reach").join(hubs, "bucket"), "minhash-state")
    # no more can be common than is not a set's own
    common = F.least(F.col("n") - F.col("own"), F.col("c_n") - F.col("c_own"))
    alike = lambda both: (100 + percent) * both >= percent * (F.col("n") + F.col("c_n"))
    near = _differ("sketch", "c_sketch") <= BINS - LEAST_AGREEMENT
    pairs = state.filter("key <> hub").filter(alike(common) & near).select("key", "hub").distinct()
    facts = compared(scratch(pairs, "minhash-pairs"), nodes, percent)
    ends = [F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")]
    tried, found = facts.select(*ends), facts.filter("linked").select(*ends)
    # of two sets one is the hub: nothing is left to compare
    state = state.filter("left > 2").withColumn("hub_n", F.col("c_n")).drop("left", "c_n", "c_own", "c_sketch")
    state = _open_buckets(state.withColumn("done", F.col("key") == F.col("hub")), found)
    state = state.join(facts.drop("linked"), ["key", "hub"], "left")
    nothing = {"lost": F.lit(0), "gained": F.lit(0), "bits": F.array(*[F.lit(0).cast("bigint")] * (LOST_BITS // 64))}
    state = state.withColumns({c: F.when(F.col("key") == F.col("hub"), v).otherwise(F.col(c)) for c, v in nothing.items()})
    # of its hub each has what it has not lost, and of the rest two sets share no more than either has beside its own
    most = F.col("hub_n") + F.least("extra", "c_extra")
    known = most - F.col("lost") - F.col("c_lost") + _shared_lost()
    # sums of numbers first: they rule out most pairs
    bounds = [alike(F.least("spare", "c_spare")), *(F.coalesce(alike(x), F.lit(True)) for x in (most - F.greatest("lost", "c_lost"), known))]
    facts = {"spare": F.col("n") - F.col("own"), "extra": F.col("gained") - F.col("own"), "twice": F.col("lost") - _ones("bits")}
    kept = ("key", "n", "root", "sketch", "lost", "bits", *facts)
    many = MORE
    while not state.filter("NOT done").isEmpty():
        # centres of this round: the set with the most links, and a growing share by turn
        left = state.filter("NOT done")
        top = left.groupBy("bucket").agg(F.max(F.struct("degree", "turn", "key")).alias("c")).select("bucket", F.col("c.key").alias("top"))
        now = ~F.col("done") & ((F.col("turn") * F.col("size") < many) | (F.col("key") == F.col("top")))
        state = scratch(state.join(top, "bucket", "left").withColumn("now", F.coalesce(now, F.lit(False))).drop("top"), "minhash-state")
        sides = state.withColumns(facts)
        centre = sides.filter("now").select("bucket", *[F.col(c).alias(f"c_{c}") for c in kept])
        # two centres of a round meet once; centres of earlier rounds have met all
        apart = "root <> c_root AND (NOT now OR key < c_key)"
        other = sides.filter("NOT done").select("bucket", "hub_n", "now", *kept).join(centre, "bucket")
        other = other.filter(bounds[0] & bounds[1] & bounds[2] & near).filter(apart)
        edges = other.select(F.least("key", "c_key").alias("a"), F.greatest("key", "c_key").alias("b")).distinct()
        edges = scratch(edges.join(tried, ["a", "b"], "left_anti"), "minhash-tried")
        tried = tried.unionAll(edges)
        new = confirmed(edges, nodes, percent)
        found = found.unionAll(new)
        state = state.withColumn("done", F.col("done") | F.col("now")).drop("now")
        # without it more pairs are compared than need be, and none is lost
        if new.count() * ANEW > left.count():
            state = _open_buckets(state.drop("root", "degree"), found)
        many *= MORE
    return found


def _alive(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The members that can have a link, with `own`, how many of their shingles no other node has, and `reach`.

    Documents that share a passage and nothing else, and copies with many changes of
    their own, would fill buckets that never close; they end here. `reach` adds up the sizes
    of a set's buckets: of the copies of a text it is greatest for those that changed least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(1)]
            rows = np.repeat(batch.column(0).to_numpy(), list(map(len, sets)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(rows)], names=["shingle", "node"])

    node = F.xxhash64("set_key").alias("node")
    rows = nodes.select(node, "shingles").mapInArrow(run, "shingle bigint, node bigint")
    alone = rows.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
    own = scratch(alone.groupBy("node").agg(F.count("*").alias("own")), "minhash-own")
    counted = members.withColumn("node", F.xxhash64("key")).join(own, "node", "left")
    counted = counted.withColumn("own", F.coalesce("own", F.lit(0)))
    counted = counted.filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    reach = F.sum("size").over(Window.partitionBy("node"))
    return scratch(counted.withColumn("reach", reach).drop("node"), "minhash-alive")


def _open_buckets(state: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets with more than one component, with `root` and `degree` (number of links)."""
    degree = found.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
    roots = components(found).withColumnRenamed("node", "key").join(degree, "key")
    rooted = state.join(roots, "key", "left").withColumns({"root": F.coalesce("root", "key"), "degree": F.coalesce("degree", F.lit(0))})
    rooted = scratch(rooted, "minhash-rooted")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    return scratch(rooted.join(mixed, "bucket", "left_semi"), "minhash-open")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link if their sets of shingles have 100 * intersection >= percent * union.
    `component_id` is the smallest id reachable over links, the document's own included;
    `kept` says whether it is the document's own. Null, empty and blank texts have no
    shingles and link with nothing; a text of fewer words is one shingle. Repeated rows
    come back as often as they are there. Rows without an id take part; their
    component_id is null if no row they reach has one, and then they are kept. Texts
    are read whole, however long. Extra columns are ignored; an empty table gives no rows.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    sets = scratch(add_buckets(named, "text", words).drop("text"), "minhash-sets")
    full = sets.filter("set_key IS NOT NULL")
    # one document stands for all of its set: that of the smallest id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    distinct = full.groupBy("set_key").agg(first, *[F.first(c).alias(c) for c in ("n_shingles", "buckets", "sketch")])
    distinct = scratch(distinct.select("set_key", "first.doc_id", "first.text_hash", "n_shingles", "buckets", "sketch"), "minhash-distinct")
    members = _members(distinct)
    found = links(members, _nodes(named, distinct, members, words), percent)
    roots = components(found).select(F.col("node").alias("set_key"), "root")
    rooted = scratch(
        distinct.join(roots, "set_key", "left").select("set_key", "doc_id", F.coalesce("root", "set_key").alias("root")), "minhash-rooted"
    )
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    whole = scratch(rooted.join(least, "root").select("set_key", "component_id"), "minhash-groups")
    columns = ("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    some = full.join(whole, "set_key").select(*columns)
    none = sets.filter("set_key IS NULL").withColumn("component_id", F.col("doc_id")).select(*columns)
    return some.unionAll(none)


def _nodes(named: DataFrame, distinct: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(set_key, shingles): each distinct set that shares a bucket, once.

    Only the documents that stand for them are gone through once more; other sets are never kept.
    """
    wanted = distinct.join(members.select(F.col("key").alias("set_key")).distinct(), "set_key", "left_semi")
    row = F.xxhash64(id_text("doc_id"), "text_hash")
    wanted = scratch(wanted.select("set_key", row.alias("row")), "minhash-wanted")
    # rows and not texts, of which there may be many copies; others that the map lets through end with their sets
    texts = likely(named, row, wanted, "row")
    rows = add_sets(texts.select("text"), "text", words).groupBy("set_key").agg(F.first("shingles").alias("shingles"))
    return scratch(rows.join(wanted.select("set_key"), "set_key", "left_semi"), "minhash-nodes")

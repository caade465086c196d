"""Near-duplicate detection by min-max hashing.

A document's set is its distinct 3-word shingles, held as 64-bit hashes. Each of
``PERMUTATIONS`` = 48 permutations is evaluated once per shingle, and both the
smallest and the largest value are kept: 96 signature values for 48
evaluations. Either end of a permutation agrees between two sets with
probability J, their Jaccard similarity, so the share of agreeing values is an
unbiased estimate, of less variance than 96 separate permutations give, since
the two ends of a permutation are drawn without replacement. A band is both
ends of two permutations; two sets are candidates if they agree in one of the 24
bands. Candidates are confirmed on their full sets: 100 * overlap >= 85 * union.

Completeness: the method is a random one. At J = 0.85, the least that links, a
pair shares no band with probability (1 - 0.85**4)**24 = 2e-8 (4e-8 for the
smallest sets that can be linked without being equal, 6 of 7 shingles); it falls
fast as J rises. Equal sets are one class and never miss. Nothing else is left to
chance or cut off, but one filter on signatures: candidates with under
``LEAST_AGREE`` = 57 of 96 values in common are dropped in the last round, which
hits a pair of J = 0.85 with probability below 1e-9.

Rounds, without listing the pairs of a bucket:

1. Star rounds: every bucket (a band's value) names one class as its hub, by an
   aggregation, and every class is compared with the hub of its buckets whose
   signature agrees most, if the two are not known to be connected already; links
   make parts that are connected. In the first round the hub is the class with most
   neighbours in its buckets, which is the text that others were copied from if it is there. In later
   rounds every bucket draws its own, so that a class has up to 24 to choose from: groups whose texts
   differ more from each other grow together. The rounds end
   when under a tenth of the pairs compared are linked, at the fourth at last.
2. Rest round, for classes in buckets that still hold several parts. A group of copies that differ too
   much to be linked has as many candidates as pairs, so these are not listed but filtered by
   prefixes: shingles are ordered by how many of these classes have them (a sketch of counts; any order gives the same
   result), rare ones first, and two sets of sizes x <= y that are linked share one of the first
   x - L(x, x) + 1 and y - L(0.85 y, y) + 1, at places that leave room for an overlap of L(x, y), the least
   that links, as must bitmaps of both sets. The pairs found by these lists, across parts, that also agree in a band and pass the
   signature filter are compared. A candidate that no round compares is in one part already or cannot be linked.

Comparisons are dealt by (hub, salt, range of hashes): a hub with many partners
is split by salt, a long set by ranges of ``SEGMENT`` shingles, partial overlaps are summed up per
pair, and a task holds one segment of one hub. The texts of classes that share
a bucket are set aside once, sets are never stored.

Defined results: with fewer than 3 words the whole sequence is one shingle;
null, empty and blank texts have no shingles and are linked with nothing, not
even each other; rows that repeat an id are documents of their own under the
same id; a null id takes part, its component is the smallest id that is not
null (null if there is none) and it is kept only then; an empty table gives an
empty table. Ids may be of any type that has an order.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_map, batches, pick, stored
from colloquy.llm.components import connected_components
from colloquy.llm.jaccard_join import _key_filter, shingle_sets
from colloquy.llm.spans import mix

N, PERCENT = 3, 85
PERMUTATIONS, BAND_PERMUTATIONS = 48, 2
BANDS = PERMUTATIONS // BAND_PERMUTATIONS
LEAST_AGREE = 57
STAR_ROUNDS = 4
HUB_MEMBERS = 500  # members of a hub compared in one group
SEGMENT = 8192  # shingles of a set in one row, about
SKETCH = 12  # values of either end that estimate a similarity where the best of several hubs is chosen
BITMAP = 1024  # bits of a set's bitmap in the lists
SLOT_BITS = (16, 22)  # least and most bits of the sketch that orders shingles: 64 KB to 4 MB
_AT_ONCE = 1 << 14  # shingles whose permutations are evaluated at a time

_numbers = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = _numbers[:PERMUTATIONS, None], _numbers[PERMUTATIONS:, None] | np.uint64(1)


def signature(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, largest) value of a set's shingles under each permutation."""
    low, high = np.full(PERMUTATIONS, 2 ** 64 - 1, dtype=np.uint64), np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(h), _AT_ONCE):
        values = (h[None, at:at + _AT_ONCE] ^ _XOR) * _ODD
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return low, high


def band_tokens(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit number per band: its place and both ends of its permutations."""
    token = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_PERMUTATIONS):
        for end in (low, high):
            token = mix(token * np.uint64(0xD1342543DE82EF95) + end[i::BAND_PERMUTATIONS])
    return token


def identity(h: np.ndarray) -> bytes:
    """Digest that names the class of documents with this set."""
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def sets_of(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, n, node (its class), band tokens and signature.

    The last two are null where the task has given them for the class before.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(it):
        seen = set()
        for b in batches(it):
            n, node, tokens, ends = [], [], [], []
            for h in shingle_sets(b.column("text").to_pylist(), N):
                n.append(len(h))
                node.append(identity(h))
                if not len(h) or node[-1] in seen:
                    tokens.append(None)
                    ends.append(None)
                    continue
                seen.add(node[-1])
                low, high = signature(h)
                tokens.append(band_tokens(low, high).view(np.int64))
                ends.append((np.concatenate((low, high)).view(np.int64) >> 48).astype(np.int16))  # enough to estimate
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                 pa.array(tokens, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int16()))],
                ["doc_id", "text_hash", "n", "node", "tokens", "ends"])

    return arrow_map(docs, make, f"doc_id {kind}, text_hash long, n long, node binary, tokens array<long>, ends array<smallint>")


def _near_size(a: str, b: str) -> Column:
    return 100 * F.least(F.col(a), F.col(b)) >= PERCENT * F.greatest(F.col(a), F.col(b))


def _agreement(a: str, b: str) -> Column:
    """How many values of two signatures are the same."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x)


def compare(texts: DataFrame, active: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of classes that are linked, from the whole sets of ``texts`` (node, n, text)."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("deg"))
    both = pairs.join(degree.select(F.col("x").alias("a"), F.col("deg").alias("deg_a")), "a") \
        .join(degree.select(F.col("x").alias("b"), F.col("deg").alias("deg_b")), "b")
    a_hub = (F.col("deg_a") > F.col("deg_b")) | ((F.col("deg_a") == F.col("deg_b")) & (F.col("a") < F.col("b")))
    sizes = active.select(F.col("node").alias("hub"), "n")
    oriented = both.select(F.when(a_hub, F.col("a")).otherwise(F.col("b")).alias("hub"),
                           F.when(a_hub, F.col("b")).otherwise(F.col("a")).alias("member"),
                           F.greatest("deg_a", "deg_b").alias("deg")).join(sizes, "hub")
    # a hub of 2**k segments or fewer is cut by the first k bits of the hashes
    cut = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / SEGMENT))).cast("int")
    oriented = stored(oriented.select("hub", "member", F.ceil(F.col("deg") / HUB_MEMBERS).alias("salts"), cut.alias("bits")),
                      "oriented")
    to_member = oriented.select(F.col("member").alias("node"), "hub", F.pmod(F.xxhash64("member"), "salts").alias("salt"), "bits")
    to_hub = oriented.groupBy("hub", "bits").agg(F.max("salts").alias("salts")).select(
        F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "bits")
    targets = to_member.union(to_hub).groupBy("node").agg(F.collect_list(F.struct("hub", "salt", "bits")).alias("targets"))
    texts = texts.join(targets, "node").select("text", "node", "targets")

    def segments(it):
        names = ["hub", "salt", "part", "is_hub", "n", "node", "segment"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]

        def given(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches(it, max_rows=256):
            rows, size = [], 0
            whole = shingle_sets(b.column("text").to_pylist(), N)
            for h, node, mine in zip(whole, b.column("node").to_pylist(), b.column("targets").to_pylist()):
                if identity(h) != node:  # another text of the same 64-bit hash
                    continue
                for t in mine:
                    edges = [0, *np.searchsorted(h, np.arange(1, 1 << t["bits"], dtype=np.uint64) << np.uint64(64 - t["bits"])),
                             len(h)] if t["bits"] else [0, len(h)]
                    for part, (x, y) in enumerate(zip(edges, edges[1:])):
                        if x < y:
                            rows.append((t["hub"], t["salt"], part, t["hub"] == node, len(h), node, h[x:y].tobytes()))
                            size += 8 * (y - x) + 100
                    if size >= 8 << 20:
                        yield given(rows)
                        rows, size = [], 0
            if rows:
                yield given(rows)

    dealt = arrow_map(texts, segments, "hub binary, salt long, part long, is_hub boolean, n long, node binary, segment binary")
    group = ["hub", "salt", "part"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, F.desc("is_hub"), "node")

    def overlap(it):
        names, kinds = ["hub", "node", "hub_n", "n", "overlap"], [pa.binary(), pa.binary(), *[pa.int64()] * 3]
        now, hub, hub_n, last = None, None, 0, None
        for b in it:
            rows = []
            for name, salt, part, is_hub, n, node, raw in zip(*(b.column(i).to_pylist() for i in range(7))):
                if (name, salt, part) != now:
                    now, hub, last = (name, salt, part), None, None
                if is_hub:
                    hub, hub_n = np.frombuffer(raw, dtype=np.uint64), n
                    continue
                if hub is None or node == last:  # the hub has nothing in this part; a repeated row
                    continue
                last, mine = node, np.frombuffer(raw, dtype=np.uint64)
                at = np.minimum(np.searchsorted(hub, mine), len(hub) - 1)
                rows.append((name, node, hub_n, n, int(np.count_nonzero(hub[at] == mine))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    partial = arrow_map(dealt, overlap, "hub binary, node binary, hub_n long, n long, overlap long")
    total = partial.groupBy("hub", "node", "hub_n", "n").agg(F.sum("overlap").alias("o"))
    alike = 100 * F.col("o") >= PERCENT * (F.col("hub_n") + F.col("n") - F.col("o"))
    return stored(total.where(alike).select(F.col("hub").alias("a"), F.col("node").alias("b")), "alike")


def least_overlap(x: int, y: int) -> int:
    """Smallest overlap of two sets of sizes x and y that are linked."""
    return -(-PERCENT * (x + y) // (100 + PERCENT))


def _shingle_levels(rest: DataFrame) -> np.ndarray:
    """Logarithm of how many sets of the table (n, node, text) have a shingle, by the last bits of its hash."""
    total = rest.agg(F.sum("n")).first()[0] or 1
    bits = min(SLOT_BITS[1], max(SLOT_BITS[0], int(total).bit_length()))

    def count(it):
        counts = np.zeros(1 << bits, dtype=np.int64)
        for b in batches(it):
            for h in shingle_sets(b.column("text").to_pylist(), N):
                np.add.at(counts, (h & np.uint64(len(counts) - 1)).astype(np.int64), 1)
        slots = np.flatnonzero(counts > 1)
        for at in range(0, len(slots), 1 << 16):
            some = slots[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["slot", "n"])

    summed = arrow_map(rest.select("text"), count, "slot long, n long").groupBy("slot").agg(
        F.floor(F.log2(F.sum("n"))).cast("tinyint").alias("level"))
    table = summed.toArrow()  # at most a row per slot
    levels = np.zeros(1 << bits, dtype=np.int8)
    levels[table.column("slot").to_numpy()] = table.column("level").to_numpy()
    return levels


def prefix_lists(rest: DataFrame) -> DataFrame:
    """(token, pos, n, node, short, bits): the first shingles of each set of the table, rare ones first.

    ``short`` says that the place is early enough for a partner that is no smaller; ``bits`` has a bit for
    every shingle's last hash bits.
    """
    levels = rest.sparkSession.sparkContext.broadcast(_shingle_levels(rest))

    def make(it):
        names = ["token", "pos", "n", "node", "short", "bits"]
        level, mask = levels.value, np.uint64(len(levels.value) - 1)
        for b in batches(it):
            for h, node in zip(shingle_sets(b.column("text").to_pylist(), N), b.column("node").to_pylist()):
                n = len(h)
                if identity(h) != node:
                    continue
                first = n - -(-PERCENT * n // 100) + 1
                marks = np.zeros(BITMAP, dtype=bool)
                marks[(h & np.uint64(BITMAP - 1)).astype(np.int64)] = True
                bits = np.packbits(marks).view(np.int64)
                order = np.argsort(level[(h & mask).astype(np.int64)], kind="stable")[:first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[order].view(np.int64)), pa.array(np.arange(first)), pa.array([n] * first, pa.int64()),
                     pa.array([node] * first, pa.binary()), pa.array(np.arange(first) <= n - least_overlap(n, n)),
                     pa.ListArray.from_arrays(pa.array(np.arange(first + 1, dtype=np.int32) * len(bits)), pa.array(np.tile(bits, first)))],
                    names)

    return arrow_map(rest.select("text", "node"), make, "token long, pos long, n long, node binary, short boolean, bits array<long>")


def _rest_pairs(active: DataFrame, texts: DataFrame, buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Candidates across components that prefixes and signatures leave."""
    open_ = stored(_with_parts(buckets, parts).select("node", "part").distinct(), "rest-classes")
    rest = stored(texts.join(open_, "node", "left_semi"), "rest-texts")
    lists = stored(prefix_lists(rest).dropDuplicates(["token", "node"]).join(open_, "node"), "prefixes")
    a, b = lists.where("short").alias("a"), lists.alias("b")
    least = F.ceil(PERCENT * (F.col("a.n") + F.col("b.n")) / F.lit(100 + PERCENT))
    # two sets differ in at least as many shingles as their bitmaps differ in bits
    differ = sum((F.bit_count(F.col("a.bits")[i].bitwiseXOR(F.col("b.bits")[i])) for i in range(BITMAP // 64)), F.lit(0))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.part") != F.col("b.part")) & _near_size("a.n", "b.n")
                 & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node"))))
                 & (F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= least)
                 & (F.col("a.n") + F.col("b.n") - differ >= 2 * least))
    pairs = stored(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "prefix-pairs")
    side = lambda x: active.select(F.col("node").alias(x), F.col("ends").alias(f"{x}_ends"),
                                   F.col("tokens").alias(f"{x}_tokens"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.arrays_overlap("a_tokens", "b_tokens") & (_agreement("a_ends", "b_ends") >= LEAST_AGREE)).select("a", "b")


def _with_parts(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several parts, with the row's part."""
    rows = buckets.join(parts, "node")
    split = rows.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("token")
    return rows.join(split, "token", "left_semi")


def _merged(parts: DataFrame, found: DataFrame) -> DataFrame:
    """Parts (node, part) joined along the links: one part is always connected, though what is connected may be several
    parts until the components are found at the end. A part goes to the smallest one that it has a link to, twice over."""
    side = lambda x: parts.select(F.col("node").alias(x), F.col("part").alias(f"p{x}"))
    ends = found.join(side("a"), "a").join(side("b"), "b").where("pa != pb")
    up = stored(ends.groupBy(F.greatest("pa", "pb").alias("part")).agg(F.min(F.least("pa", "pb")).alias("to")), "ups")
    for _ in range(2):
        up = up.join(up.select(F.col("part").alias("to"), F.col("to").alias("next")), "to", "left").select(
            "part", F.coalesce("next", "to").alias("to"))
    return stored(parts.join(up, "part", "left").select("node", F.coalesce("to", "part").alias("part")), "parts")


def links(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with their classes, links between classes): the links connect all that are connected."""
    docs = pick(documents, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    sets = stored(sets_of(docs), "minmax-sets")
    given = sets.where("tokens IS NOT NULL")  # once a class and task
    every = given.select("node", F.explode("tokens").alias("token"))
    shared = every.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("token")
    pairs = stored(every.join(shared, "token").distinct(), "bucket-classes")
    active = stored(given.join(pairs.select("node").distinct(), "node", "left_semi").groupBy("n", "node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("key"),
        F.max("ends").alias("ends"), F.max("tokens").alias("tokens")), "active-classes")
    sketch = F.concat(F.slice("ends", 1, SKETCH), F.slice("ends", PERMUTATIONS + 1, SKETCH))
    sizes = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    buckets = stored(pairs.join(sizes, "token").join(active.select("node", "n", sketch.alias("sketch")), "node"), "buckets")
    keys = active.select("node", "n", F.col("key.doc_id").alias("id"), F.col("key.text_hash").alias("key"))
    rows = docs.where(_key_filter(keys)(F.xxhash64("text_hash")))
    texts = stored(rows.join(keys, rows["doc_id"].eqNullSafe(keys["id"]) & (rows["text_hash"] == keys["key"])).select(
        "node", "n", "text"), "active-texts")

    tested, found = [], []
    parts = active.select("node", F.col("node").alias("part"))

    def test(pairs: DataFrame) -> bool:
        """Compare the pairs that were not compared before; whether enough of them were linked to go on alike."""
        nonlocal parts
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested:
            pairs = pairs.join(reduce(DataFrame.union, tested), ["a", "b"], "left_anti")
        pairs = stored(pairs, "candidates")
        n = pairs.count()
        if not n:
            return False
        tested.append(pairs)
        found.append(compare(texts, active, pairs))
        parts = _merged(parts, found[-1])
        return 10 * found[-1].count() >= n

    for number in range(STAR_ROUNDS):
        rows = stored(_with_parts(buckets, parts), "split-buckets")
        if number:
            rank = F.xxhash64("node", "token", F.lit(number))
        else:
            met = rows.groupBy("node").agg(F.sum("size").alias("met"))
            rows, rank = rows.join(met, "node"), -F.col("met")
        drawn = F.struct(rank.alias("rank"), "node", "n", "part", "sketch")
        hubs = rows.groupBy("token").agg(F.min(drawn).alias("h")).select(
            "token", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.part").alias("hub_part"),
            F.col("h.sketch").alias("hub_sketch"))
        named = rows.join(hubs, "token").where((F.col("part") != F.col("hub_part")) & _near_size("n", "hub_n"))
        near = named.select("node", "hub", _agreement("sketch", "hub_sketch").alias("near"))
        stars = near.groupBy("node").agg(F.max(F.struct("near", "hub")).alias("best")).where(F.col("best.near") >= SKETCH).select(
            "node", F.col("best.hub").alias("hub"))
        if not test(stars.select(F.col("node").alias("a"), F.col("hub").alias("b"))):
            break
    test(_rest_pairs(active, texts, buckets, parts))
    none = active.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    return sets.select("doc_id", "n", "node"), reduce(DataFrame.union, found) if found else none


def components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable) and kept (it is that id)."""
    sets, found = links(documents, id_col, text_col)
    parts = connected_components(found, "a", "b")
    ids = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    ids = stored(ids.join(parts, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("part")), "ids")
    least = ids.groupBy("part").agg(F.min("least_id").alias("component_id"))
    of_class = stored(ids.join(least, "part").select("node", "component_id"), "class-ids")
    out = sets.join(of_class, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

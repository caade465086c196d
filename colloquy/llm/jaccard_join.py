"""Jaccard join of documents on word n-grams, by vertical partitioning.

A document's set is its distinct 5-word shingles, held as 64-bit hashes. All
shingles have one global order: rare ones first (by hash), then those that
many documents share, by how many. The order is cut into fragments, rare
shingles by ranges of their hash and the frequent ones as the last, so that a
document is cut into segments. For a pair of documents the segments of each
fragment are counted against each other on their own, and the partial overlaps
are summed up per pair; 100 * overlap >= 80 * union makes a link.

Which pairs are counted:

1. Equal sets are one class; every further step works on classes.
2. Two sets of sizes x <= y that are 80 % alike share one of the first
   y - ceil(0.8 y) + 1 shingles of the longer one and of the first
   x - ceil(8 x / 9) + 1 of the shorter one (prefix filter), and from the
   first shingle that they share at least ceil(0.8 / 1.8 (x + y)) must be left
   (positional filter). Prefix shingles are dealt by shingle.
3. Star round: in the list of a shingle the first class (fewest rarer
   shingles before it) of each range of sizes is a hub, every other class is
   counted against the hub that most of its shingles name, and the links'
   components are found. No pairs inside a group of copies are made.
4. Rest round: lists that still hold more than one component give the pairs
   across components that pass the prefix, positional, length and bitmap
   filters, and these are all counted. (A bitmap has a bit for a shingle's last
   hash bits; as many bits as differ, so many shingles differ at least.) A pair that was in no list with a
   partner of another component is either linked through others or not alike,
   so the components are exact.

A hub's group is split by salt, a shingle's list is only ever aggregated,
streamed past with a bounded state, or joined with skew handling. Ids are integers.

Order table: shingles that are found twice or more within blocks of some
million shingles are counted over all documents; those with a count of 8 or
more are frequent. They share the slots of a table by their last hash bits, with
a level for the slot's count: four slots for each of them, at most 2**24, so
the table that goes to the tasks has at most 16 MB. Shingles that fall into a
frequent one's slot by chance only come later in the order. The order decides how much
work is done, never a result.

Defined results: with fewer than 5 words the whole sequence is one shingle;
null, empty and blank texts have no shingles and are linked with nothing, not
even each other; rows that repeat an id are documents of their own under the
same id; a null id takes part, and its component is the smallest id that is
not null (null if there is none); an empty table gives an empty table.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_map, batches, pick, stored, unused
from colloquy.llm.components import connected_components
from colloquy.llm.spans import joined, mix, sorted_distinct, span_hashes

N = 5
PERCENT = 80
BITS, MAX_BITS = 512, 1 << 16
RARE_FRAGMENTS = 4
FREQUENT_MIN = 8
MIN_SLOT_BITS, MAX_SLOT_BITS = 16, 24
BLOCK_SHINGLES = 1 << 21
HUB_MEMBERS = 500  # members of a hub counted in one group
FILTER_BITS = 24
_NO_ID = -(1 << 63)

_MULTIPLIER = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK_BYTES = 1 << 20  # bytes of texts that are hashed at a time


def shingle_sets(texts: list[str | None], n: int = N) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each whole text."""
    held: list[str | None] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= CHUNK_BYTES:
            yield from _shingle_chunk(held, n)
            held, size = [], 0
    if held:
        yield from _shingle_chunk(held, n)


def _shingle_chunk(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    raw, offsets = joined(texts, lower=True)
    blank = np.concatenate(([True], _SPACE[raw]))  # every text ends in a line feed
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    words = span_hashes(raw, starts, ends)
    bounds = np.searchsorted(starts, offsets)

    def runs(w: np.ndarray, size: int) -> np.ndarray:
        h = w[:max(0, len(w) - size + 1)].copy()
        for i in range(1, size):
            h *= _MULTIPLIER
            h += w[i:len(w) - size + 1 + i]
        return mix(h + np.uint64(size))

    full = runs(words, n)  # those across texts are left out below
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            yield sorted_distinct(full[a:b - n + 1])
        else:
            yield runs(words[a:b], b - a) if b > a else words[:0]


def shingles(text: str | None, n: int = N) -> np.ndarray:
    return next(shingle_sets([text], n))


def least_overlap(x: int, y: int) -> int:
    """Smallest overlap of two sets of sizes x and y that are linked."""
    return -(-PERCENT * (x + y) // (100 + PERCENT))


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


class Order:
    """The global order: shingles by the level of their slot, then by hash.

    ``levels`` has a level for every value of a shingle's last hash bits: 0 for
    slots without frequent shingles, else the logarithm of their count.
    """

    def __init__(self, levels: np.ndarray):
        self.levels, self.mask = levels, np.uint64(len(levels) - 1)

    def split(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rare shingles by hash, frequent shingles by level and hash)."""
        level = self.levels[(h & self.mask).astype(np.int64)]
        common = level > 0
        if not common.any():
            return h, h[:0]
        late = h[common]
        return h[~common], late[np.argsort(level[common], kind="stable")]

    def segments(self, h: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(fragment, sorted shingles) of a set; empty segments are left out."""
        rare, late = self.split(h)
        cuts = np.searchsorted(rare, np.arange(1, RARE_FRAGMENTS, dtype=np.uint64) << np.uint64(62))
        parts = [*np.split(rare, cuts), np.sort(late)]
        return [(f, p) for f, p in enumerate(parts) if len(p)]


def identity(h: np.ndarray) -> int:
    """64-bit digest of a set; with its size it names the class of equal sets."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bitmap(h: np.ndarray, size: int = BITS) -> np.ndarray:
    bits = np.zeros(size, dtype=bool)
    bits[(h & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def wide_bits(n: int) -> int:
    """Bits of the wide bitmap of a set: two to four for a shingle, within bounds."""
    return min(MAX_BITS, max(BITS, 1 << (2 * n - 1).bit_length()))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def global_order(docs: DataFrame) -> Order:
    """Count the shingles that repeat within blocks of documents, over all documents."""
    def count(it):
        held, size = [], 0

        def flush():
            all_of = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], all_of[1:] != all_of[:-1])))
            n = np.diff(np.append(first, len(all_of)))
            keys, n = all_of[first[n > 1]], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["token", "n"])

        for b in batches(it):
            for h in shingle_sets(b.column("text").to_pylist()):
                held.append(h)
                size += len(h)
                if size >= BLOCK_SHINGLES:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
    counted = arrow_map(docs.select("text"), count, "token long, n long")
    frequent = stored(counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_MIN), "frequent")
    slots = 1 << min(MAX_SLOT_BITS, max(MIN_SLOT_BITS, (4 * frequent.count()).bit_length()))
    table = frequent.groupBy(F.col("token").bitwiseAND(F.lit(slots - 1)).cast("int").alias("slot")).agg(
        F.floor(F.log2(F.sum("n"))).cast("tinyint").alias("level")).toArrow()  # at most a row per slot
    levels = np.zeros(slots, dtype=np.int8)
    levels[table.column("slot").to_numpy()] = table.column("level").to_numpy()
    return Order(levels)


def sets_of(docs: DataFrame, order) -> DataFrame:
    """Per document: doc_id, text_hash, n, node (class of equal sets, with n), prefix and bitmaps.

    The last three are empty where the task has given them for the class before.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(it):
        seen = set()  # classes whose prefix this task has given
        for b in batches(it):
            n, node, prefix, bits, wide = [], [], [], [], []
            for h in shingle_sets(b.column("text").to_pylist()):
                n.append(len(h))
                node.append(identity(h))
                if not len(h) or (n[-1], node[-1]) in seen:
                    for column in (prefix, bits, wide):
                        column.append(h[:0])
                    continue
                seen.add((n[-1], node[-1]))
                p = prefix_size(len(h))
                rare, late = order.value.split(h)
                prefix.append(rare[:p] if len(rare) >= p else np.concatenate((rare, late[:p - len(rare)])))
                bits.append(_bitmap(h))
                wide.append(_bitmap(h, wide_bits(len(h))))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                 _lists(prefix), _lists(bits), _lists(wide)],
                ["doc_id", "text_hash", "n", "node", "prefix", "bits", "wide"])

    return arrow_map(docs, make, f"doc_id {kind}, text_hash long, n long, node long, prefix array<long>, "
                     "bits array<long>, wide array<long>")


def _star(it):
    """Stream lists sorted by (token, pos, ...): keep lists of two or more, name the hubs of each row.

    The state is the hubs of the current list, one for each range of sizes.
    """
    names = ["token", "pos", "n", "node", "h_n", "h_node", "main"]
    kinds = [pa.int64()] * 6 + [pa.bool_()]
    token, first, hubs, last = None, None, {}, None

    def size_range(n: int) -> int:
        return int(np.log(n) / np.log(100 / PERCENT))

    for b in it:
        cols = {c: np.asarray(b.column(c)) for c in ("token", "pos", "n", "node")}
        t = cols["token"]
        if not len(t):
            continue
        # equal sets that several tasks gave stand next to each other: one is enough
        twice = np.concatenate(([(int(t[0]), int(cols["n"][0]), int(cols["node"][0])) == last],
                                (t[1:] == t[:-1]) & (cols["n"][1:] == cols["n"][:-1]) & (cols["node"][1:] == cols["node"][:-1])))
        last = (int(t[-1]), int(cols["n"][-1]), int(cols["node"][-1]))
        cols = {c: v[~twice] for c, v in cols.items()}
        t = cols["token"]
        if not len(t):
            continue
        # rows whose neighbours hold another shingle are alone, except at the batch's ends
        same = t[1:] == t[:-1]
        keep = np.concatenate(([True], same)) | np.concatenate((same, [True]))
        rows: list[tuple] = []
        for tok, pos, n, node in zip(*(cols[c][keep].tolist() for c in ("token", "pos", "n", "node"))):
            r = size_range(n)
            if tok != token:
                token, first, hubs = tok, (tok, pos, n, node, None, None, True), {r: (n, node)}
                continue
            if first is not None:
                rows.append(first)
                first = None
            near = [hubs[x] for x in (r, r - 1, r + 1) if x in hubs]
            near = [h for h in near if h != (n, node) and 100 * min(h[0], n) >= PERCENT * max(h[0], n)]
            rows.append((tok, pos, n, node, *(near[0] if near else (None, None)), True))
            rows += [(tok, pos, n, node, *h, False) for h in near[1:]]
            hubs.setdefault(r, (n, node))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _pair(n: str, node: str) -> Column:
    return F.struct(F.col(n).alias("n"), F.col(node).alias("node"))


def _key_filter(keyed: DataFrame):
    """A test on ``xxhash64(key)`` that passes every key of a table, and others by chance.

    It is a bitmap of fixed size (2 MB), so it can go to every task; it spares
    the join the texts of most documents that it has no use for.
    """
    h = F.pmod(F.xxhash64("key"), F.lit(1 << FILTER_BITS))
    words = keyed.groupBy(F.shiftright(h, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(pmod(xxhash64(key), {1 << FILTER_BITS}) & 63))")).alias("bits"))
    table = words.toArrow()  # at most 2**FILTER_BITS / 64 rows
    bitmap = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bitmap[table.column("w").to_numpy()] = table.column("bits").to_numpy()
    sent = keyed.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    @F.pandas_udf("boolean")
    def may_have(hashes: pd.Series) -> pd.Series:
        h = hashes.to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
        return pd.Series((sent.value[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1)

    return may_have


def may_be_alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose wide bitmaps leave room for the overlap that a link needs.

    Two sets differ in at least as many shingles as their bitmaps differ in
    bits; a bitmap of twice the other's size is folded first.
    """
    side = lambda x: classes.select(_pair("n", "node").alias(x), F.col("wide").alias(f"{x}_wide"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    size = F.least(F.size("a_wide"), F.size("b_wide"))

    def folded(c: str):
        upper = F.slice(c, size + 1, size)
        return F.when(F.size(c) > size, F.zip_with(F.slice(c, 1, size), upper, lambda x, y: x.bitwiseOR(y))).otherwise(F.col(c))

    differ = F.aggregate(F.zip_with(folded("a_wide"), folded("b_wide"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                         F.lit(0), lambda total, d: total + d)
    both_n = F.col("a.n") + F.col("b.n")
    return both.where(both_n - differ >= 2 * F.ceil(PERCENT * both_n / F.lit(100 + PERCENT))).select("a", "b")


def count_overlaps(docs: DataFrame, classes: DataFrame, pairs: DataFrame, order) -> DataFrame:
    """The pairs (structs a, b of n and node) that are linked.

    Of a pair the class with more pairs is the hub. A document that takes part
    is read once more; its segments go to the groups (hub, salt, fragment)
    that need them, a hub's to each of its salts. A group counts each member's
    segment against the hub's, and partial overlaps are summed per pair.
    """
    ends = stored(pairs.select("a", "b").distinct(), "pairs")
    ends = ends.select("a", "b")
    degree = ends.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("deg"))
    with_a = ends.join(degree.select(F.col("x").alias("a"), F.col("deg").alias("deg_a")), "a")
    both = with_a.join(degree.select(F.col("x").alias("b"), F.col("deg").alias("deg_b")), "b")
    a_hub = (F.col("deg_a") > F.col("deg_b")) | ((F.col("deg_a") == F.col("deg_b")) & (F.col("a") < F.col("b")))
    oriented = stored(both.select(F.when(a_hub, F.col("a")).otherwise(F.col("b")).alias("hub"),
                                  F.when(a_hub, F.col("b")).otherwise(F.col("a")).alias("member"),
                                  F.greatest("deg_a", "deg_b").alias("deg")), "oriented")
    salts = F.ceil(F.col("deg") / HUB_MEMBERS)
    to_member = oriented.select(F.col("member").alias("x"), F.col("hub"),
                                F.pmod(F.xxhash64("member"), salts).alias("salt"), F.lit(False).alias("is_hub"))
    to_hub = oriented.groupBy("hub").agg(F.max("deg").alias("deg")).select(
        F.col("hub").alias("x"), "hub", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("is_hub"))
    targets = to_member.union(to_hub).groupBy("x").agg(F.collect_list(
        F.struct("hub.n", "hub.node", "salt", "is_hub")).alias("targets"))
    where = stored(targets.join(classes.select(_pair("n", "node").alias("x"), "key"), "x").select("key", "x.n", "x.node",
                                                                                                  "targets"), "targets")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), "text")
    keyed = keyed.where(_key_filter(where)(F.xxhash64("key")))

    def cut(it):
        names = ["h_n", "h_node", "salt", "fragment", "is_hub", "n", "node", "segment"]
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches(it, max_rows=256):
            rows, size = [], 0
            texts, *rest = (b.column(c).to_pylist() for c in ("text", "n", "node", "targets"))
            for h, n, node, targets in zip(shingle_sets(texts), *rest):
                if len(h) != n or identity(h) != node:  # another text under the same id
                    continue
                for f, segment in order.value.segments(h):
                    raw = segment.tobytes()
                    for t in targets:
                        rows.append((t["n"], t["node"], t["salt"], f, t["is_hub"], n, node, raw))
                        size += len(raw)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    segments = arrow_map(keyed.join(where, "key").select("text", "n", "node", "targets"), cut,
                         "h_n long, h_node long, salt long, fragment long, is_hub boolean, n long, node long, segment binary")
    group = ["h_n", "h_node", "salt", "fragment"]
    dealt = segments.repartition(*group).sortWithinPartitions(*group, F.desc("is_hub"), "n", "node")

    def overlap(it):
        names = ["h_n", "h_node", "n", "node", "overlap"]
        now, hub, last = None, np.empty(0, dtype=np.uint64), None
        for b in it:
            rows = []
            for h_n, h_node, salt, f, is_hub, n, node, raw in zip(*(b.column(i).to_pylist() for i in range(8))):
                if (h_n, h_node, salt, f) != now:
                    now, last, hub = (h_n, h_node, salt, f), None, np.empty(0, dtype=np.uint64)
                if is_hub:
                    hub = np.frombuffer(raw, dtype=np.uint64)
                    continue
                if (n, node) == last or not len(hub):  # a repeated row; a fragment in which the hub has nothing
                    continue
                last = (n, node)
                mine = np.frombuffer(raw, dtype=np.uint64)
                at = np.minimum(np.searchsorted(hub, mine), len(hub) - 1)
                rows.append((h_n, h_node, n, node, int(np.count_nonzero(hub[at] == mine))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    partial = arrow_map(dealt, overlap, "h_n long, h_node long, n long, node long, overlap long")
    total = partial.groupBy("h_n", "h_node", "n", "node").agg(F.sum("overlap").alias("o"))
    alike = 100 * F.col("o") >= PERCENT * (F.col("h_n") + F.col("n") - F.col("o"))
    return stored(total.where(alike).select(_pair("h_n", "h_node").alias("a"), _pair("n", "node").alias("b")), "alike")


def _can_link(a: str, b: str) -> Column:
    """Length, positional and bitmap filters for a list's rows a and b, a being the shorter set."""
    c = lambda x, name: F.col(f"{x}.{name}")
    least = F.ceil(PERCENT * (c(a, "n") + c(b, "n")) / F.lit(100 + PERCENT))
    differ = sum((F.bit_count(c(a, "bits")[i].bitwiseXOR(c(b, "bits")[i])) for i in range(BITS // 64)), F.lit(0))
    return ((100 * c(a, "n") >= PERCENT * c(b, "n"))
            & (F.least(c(a, "n") - c(a, "pos"), c(b, "n") - c(b, "pos")) >= least)
            & (c(a, "n") + c(b, "n") - differ >= 2 * least))


def links(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with their classes, links between classes): the links found connect all that are connected."""
    docs = pick(documents, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    order = documents.sparkSession.sparkContext.broadcast(global_order(docs))  # at most 16 MB
    sets = stored(sets_of(docs, order), "sets")
    classes = stored(sets.where("n > 0").groupBy("n", "node").agg(
        F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).alias("key"),
        F.max("bits").alias("bits"), F.max("wide").alias("wide")), "classes")

    lists = sets.select("n", "node", F.posexplode("prefix").alias("pos", "token"))
    order_by = ["token", "pos", "n", "node"]
    shared = stored(arrow_map(lists.repartition("token").sortWithinPartitions(*order_by).select(*order_by), _star,
                              "token long, pos long, n long, node long, h_n long, h_node long, main boolean"), "shared")
    named = shared.where(F.col("h_node").isNotNull()).groupBy("n", "node", "h_n", "h_node").agg(
        F.count(F.lit(1)).alias("votes"))
    best = Window.partitionBy("n", "node").orderBy(F.desc("votes"), "h_n", "h_node")
    stars = named.withColumn("r", F.row_number().over(best)).where("r = 1").select(
        _pair("n", "node").alias("a"), _pair("h_n", "h_node").alias("b"))
    stars = stored(may_be_alike(stars, classes), "stars")
    found = count_overlaps(docs, classes, stars, order)

    parts = connected_components(found, "a", "b").select(
        F.col("node.n").alias("n"), F.col("node.node").alias("node"), F.col("component.n").alias("c_n"),
        F.col("component.node").alias("c_node"))
    rows = shared.where("main").join(parts, ["n", "node"], "left").select(
        "token", "pos", "n", "node", F.coalesce("c_n", "n").alias("c_n"), F.coalesce("c_node", "node").alias("c_node"))
    rows = stored(rows, "rest")
    split = rows.groupBy("token").agg(*[f(c).alias(f"{k}_{c}") for c in ("c_n", "c_node")
                                        for k, f in (("lo", F.min), ("hi", F.max))])
    split = split.where("lo_c_n != hi_c_n or lo_c_node != hi_c_node").select("token")
    rest = rows.join(split, "token", "left_semi").join(classes.select("n", "node", "bits"), ["n", "node"])
    rest = stored(rest, "rest")
    least = F.ceil(2 * PERCENT * F.col("n") / F.lit(100 + PERCENT))
    short = rest.where(F.col("pos") <= F.col("n") - least).alias("a")
    across = short.join(rest.alias("b"), (F.col("a.token") == F.col("b.token"))
                        & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node"))))
                        & ((F.col("a.c_n") != F.col("b.c_n")) | (F.col("a.c_node") != F.col("b.c_node")))
                        & _can_link("a", "b"))
    more = across.select(_pair("a.n", "a.node").alias("a"), _pair("b.n", "b.node").alias("b")).distinct()
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(may_be_alike(more.join(done, ["a", "b"], "left_anti"), classes), "more")
    if not more.isEmpty():
        found = found.union(count_overlaps(docs, classes, more, order))
    return sets.select("doc_id", "text_hash", "n", "node"), found


def _with_components(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, text_hash, n, its component's smallest class (c_n, c_node) and smallest id."""
    sets, found = links(documents, id_col, text_col)
    parts = connected_components(found, "a", "b").select(
        F.col("node.n").alias("n"), F.col("node.node").alias("node"), F.col("component.n").alias("c_n"),
        F.col("component.node").alias("c_node"))
    ids = sets.where("n > 0").groupBy("n", "node").agg(F.min("doc_id").alias("least_id"))
    ids = stored(ids.join(parts, ["n", "node"], "left").select(
        "n", "node", "least_id", F.coalesce("c_n", "n").alias("c_n"), F.coalesce("c_node", "node").alias("c_node")),
        "class-components")
    least = ids.groupBy("c_n", "c_node").agg(F.min("least_id").alias("component_id"))
    of_class = stored(ids.join(least, ["c_n", "c_node"]).select("n", "node", "c_n", "c_node", "component_id"), "class-ids")
    return sets.join(of_class, ["n", "node"], "left")


def components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id (smallest id reachable)."""
    return _with_components(documents, id_col, text_col).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, one of each component: that with the smallest id
    (null ids last, then by a hash of the text); rows that repeat it are one. Blank texts stay."""
    found = stored(_with_components(documents, id_col, text_col).where("n > 0"), "components")
    firsts = found.groupBy("c_n", "c_node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"),
        F.count(F.lit(1)).alias("rows")).where("rows > 1")
    firsts = stored(firsts.select("c_n", "c_node", F.col("first.doc_id").alias("_id"),
                                  F.col("first.text_hash").alias("_hash")), "firsts")
    gone_id, gone_hash = unused(documents, "gone_id", "gone_hash")
    many = found.join(firsts, ["c_n", "c_node"])
    is_first = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash"))
    gone = stored(many.where(~is_first).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct(),
                  "dropped")
    hashed = F.xxhash64(documents[text_col])
    left = documents.join(gone, documents[id_col].eqNullSafe(gone[gone_id]) & (hashed == gone[gone_hash]), "left_anti")
    # rows that repeat a kept document
    repeated = stored(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(
        F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)), "repeated")
    if repeated.isEmpty():
        return left
    again = left[id_col].eqNullSafe(repeated[gone_id]) & (F.xxhash64(left[text_col]) == repeated[gone_hash])
    once = left.join(repeated, again, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(repeated, again, "left_anti").unionByName(once)

"""Packing by a configuration linear program over the length histogram.

A configuration says how many pieces of each length share a sequence. The
program wants the fewest sequences that hold all pieces: minimise the sum of
x_c subject to sum_c a(l, c) x_c >= n_l for every length l. The histogram has
at most ``capacity`` rows, so the program does not grow with the corpus.

It is solved by multiplicative weights. Every length has a weight, at first its
length; each round prices configurations by a knapsack over the capacity
(dynamic program), takes for every length the best configuration that holds it
if its value is within ``SLACK`` of the best of all, adds a small step of
these, and lowers the weights of lengths by how far their pieces are covered.
The steps of full configurations are rounded down to whole sequences, those
with the longest pieces first, as far as pieces are left; the rest is packed by best fit, longest piece first, on the
histogram, whole multiples of a configuration at a time.

Spark does the rest: documents are tokenized and cut in tasks, lengths counted,
pieces ranked within their length without a task per length, and each piece
finds its sequence and place from its length and rank by binary search in the
plan, which has a few rows per configuration.

Defined results: a null or empty text is one piece with the end id alone;
repeated rows are packed each; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_map, batches, gapless_rank, pick, stored
from colloquy.llm.tokens import encoder, tokenizer_json

#: A configuration is rounded if it fills this share of a sequence.
FULL = 0.999
#: Shares of the solution at which it is rounded.
SHARES = (1.0, 0.75, 0.5, 0.25)
#: Rounds of the solver, share of a length covered by a round's step, how near
#: to the best value a configuration must be, and how many are rounded at most.
ROUNDS, STEP, SLACK, CONFIGURATIONS = 80, 0.05, 0.02, 4000


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value for every capacity, and the first length to take (0: none)."""
    best = np.zeros(capacity + 1)
    first = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        total = values[:k] + best[c - lengths[:k]]
        i = int(np.argmax(total))
        if total[i] > best[c - 1]:
            best[c], first[c] = total[i], lengths[i]
        else:
            best[c], first[c] = best[c - 1], 0
    return best, first


def _fill(first: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if first[room]:
            out.append(int(first[room]))
            room -= int(first[room])
        else:
            room -= 1
    return out


def solve(counts: dict[int, int], capacity: int) -> dict[tuple[int, ...], float]:
    """Fractional number of sequences per configuration (lengths in falling order)."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    need = np.array([counts[x] for x in lengths.tolist()], dtype=np.float64)
    place = {x: i for i, x in enumerate(lengths.tolist())}
    covered = np.zeros(len(lengths))
    x: dict[tuple[int, ...], float] = {}
    for _ in range(ROUNDS):
        values = lengths * np.exp(-2.0 * covered) * (covered < 1)
        if not values.any():
            break
        best, first = price(values, lengths, capacity)
        with_it = values + best[capacity - lengths]
        chosen = np.flatnonzero((with_it >= (1 - SLACK) * with_it.max()) & (values > 0))
        configurations = [tuple(sorted([int(lengths[i]), *_fill(first, capacity - int(lengths[i]))], reverse=True))
                          for i in chosen]
        use = np.zeros(len(lengths))
        for c in configurations:
            for length in c:
                use[place[length]] += 1
        step = STEP * float((need[use > 0] / use[use > 0]).min())
        # rounds that one scarce length holds back would take no step worth having
        step = max(step, STEP * float(np.median(need[chosen])) / max(1.0, float(np.median(use[chosen]))))
        for c in configurations:
            x[c] = x.get(c, 0.0) + step
        covered += step * use / need
    return x


def pack(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, sequences) pairs that hold every piece once.

    The solution is approximate, so rounding all of it can use up short pieces
    that long ones need. It is rounded at several shares, and the packing with the
    fewest sequences is taken.
    """
    shorter = {length: n for length, n in counts.items() if n and length < capacity}
    fractional = solve(shorter, capacity) if shorter else {}
    # only (nearly) full configurations are rounded, since what they waste is lost
    full = heapq.nlargest(CONFIGURATIONS, ((x, c) for c, x in fractional.items() if sum(c) >= FULL * capacity))
    full.sort(key=lambda e: (-e[1][0], -sum(e[1]), -e[0]))
    return min((_round(counts, capacity, full, share) for share in SHARES), key=lambda plan: sum(k for _, k in plan))


def _round(counts: dict[int, int], capacity: int, full: list, share: float) -> list[tuple[tuple[int, ...], int]]:
    """Round the solution's configurations at a share and pack the rest by best fit."""
    left = {length: n for length, n in counts.items() if n}
    out = []

    def take(configuration: tuple[int, ...], most: int) -> int:
        uses = {length: configuration.count(length) for length in set(configuration)}
        k = min([most, *(left.get(length, 0) // a for length, a in uses.items())])
        if k > 0:
            out.append((configuration, k))
            for length, a in uses.items():
                left[length] -= k * a
                if not left[length]:
                    del left[length]
        return k

    # pieces that fill a sequence need no program
    if capacity in left:
        take((capacity,), left[capacity])
    for x, configuration in full:
        take(configuration, int(share * x))
    while left:
        lengths = np.array(sorted(left), dtype=np.int64)
        room, configuration, used = capacity, [], {}
        while room > 0:
            k = int(np.searchsorted(lengths, room, side="right")) - 1
            while k >= 0 and left[int(lengths[k])] <= used.get(int(lengths[k]), 0):
                k -= 1
            if k < 0:
                break
            length = int(lengths[k])
            configuration.append(length)
            used[length] = used.get(length, 0) + 1
            room -= length
        take(tuple(configuration), 1 << 62)
    return out


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as runs: pieces of ``length`` with ranks from ``first`` on stand ``per`` to a
    sequence, from sequence ``sequence`` and offset ``offset`` on; sorted by (length, first)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for configuration, k in plan:
        offset = 0
        for length in sorted(set(configuration), reverse=True):
            per = configuration.count(length)
            rows.append((length, used.get(length, 0), per, sequence, offset))
            used[length] = used.get(length, 0) + per * k
            offset += per * length
        sequence += k
    cols = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "per", "sequence", "offset"), cols))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * bool(head) + [(at, capacity) for at in range(head, n, capacity)]


def pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per piece, with the task that made it and its running number within (task, length)."""
    docs = pick(documents, doc_id=id_col, text=text_col)
    model = documents.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))  # some 2 MB
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(it):
        from pyspark import TaskContext

        enc, part = encoder(model.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches(it):
            at, rows = [], []
            for k, ids in enumerate(enc.encode_many(b.column("text").to_pylist())):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                for i, (start, length) in enumerate(cut(len(ids) + 1, capacity)):
                    at.append(k)
                    rows.append((i, start, length, zlib.crc32(raw[4 * start:4 * (start + length)]), part, int(seen[length])))
                    seen[length] += 1
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.int64()] * 5])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), *cols],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_local"])

    return arrow_map(docs, make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                     "_part long, _local long")


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = stored(pieces(documents, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    counts = {int(r[0]): int(r[1]) for r in made.groupBy("length").count().collect()}  # at most capacity rows
    plan = places(pack(counts, capacity))
    names = [f.name for f in made.schema if not f.name.startswith("_")]

    def put(it):
        # (length, first) as one sorted number; a rank is below 2**48
        keys = (plan["length"] << 48) + plan["first"]
        for b in it:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            run = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            nth, slot = np.divmod(rank - plan["first"][run], plan["per"][run])
            cols = [pa.array(plan["sequence"][run] + nth), pa.array(plan["offset"][run] + slot * length)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *cols], [*names, "sequence_id", "offset"])

    ranked = gapless_rank(made, "length", "rank", "_part", "_local").select(*names, "rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return arrow_map(ranked, put, f"{kinds}, sequence_id long, offset long")

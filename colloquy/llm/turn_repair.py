"""Repair of conversation structure by aligning turns to the alternating grammar.

A conversation should read ``(s?(ua)+)?``: perhaps a system turn, then user
and assistant in turn, or nothing. Keep costs 0, Rerole (to user or assistant)
2, Delete 3, Insert (an empty user or assistant turn, anywhere) 2; a truncated
turn that stays adds 1; blank and duplicate turns must be deleted. The audit of
a repair is its edits' initials in order; of the cheapest repairs the one with
the ASCII-least audit is taken.

Method: Wagner-Fischer alignment of the turns with the grammar's string of
each feasible length. All these strings that end alike share their ends, so
one table per ending (rows: turns left, columns: letters left) aligns all
lengths. It is filled within Ukkonen's band: the cost of aligning without a
shift is the incumbent, and a cell whose turns left and letters left differ by
more than the incumbent pays for is on no cheapest path. Every length that
reaches the least cost is traced back, and the audits are compared.

Turns with the same initials and faults have the same repair, so a worker
remembers repairs by that signature.

Scale: conversations of up to ``SHORT_ROWS`` rows and ``SHORT_CHARS``
characters are dealt by id, sorted and streamed, one conversation held at a
time. Longer ones are cut: equal rows are counted, first occurrences are found by an
aggregation, and rows are dealt by ranges of (conversation, turn) into blocks of ``BLOCK_ROWS``. A
block is aligned from each state of the grammar to each (start, after system,
after user, after assistant; insertions belong to the block that follows, so
that a path has one way through the blocks). The blocks' 4 x 4 costs are
chained backwards and the cheapest, ASCII-least path is followed forwards; two
pieces of audit over the same turns are never one the beginning of the other,
so the choice is made block by block. One task sees the 32 numbers of a block
of a long conversation, and its blocks once more, one at a time, to hash the
repaired text: SHA-256 has to read it in order. Nothing else is held but the
audit, which is part of the result row.

Rows of a conversation are taken by turn (nulls first), rows of one turn by
role, then text. Faults, the first that applies: blank (nothing but white
space ``[\\x20\\x09-\\x0D]``), duplicate (a row before has the same role and
text), truncated (the last character that is not white space is none of ``.!?``).

Defined results: null roles and texts are one space, so a null text is blank
and a null role needs a new one; a null id is a conversation of its own;
repeated rows are duplicates; a role's initial is its first character, that of
an empty role is none and fits nothing; ids may be of any type, turns are
integers; a conversation named only by rows that are not ``present`` has zeros,
an empty audit and the hash of the empty string, and so has one that the
repair leaves empty (but for its counts); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_map, pick, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SHORT_ROWS, SHORT_CHARS = 256, 4 << 20
BLOCK_ROWS, BLOCK_CHARS = 256, 4 << 20

_BLANK = " \t\n\v\f\r"
_STATES = "0sua"  # nothing yet, after the system turn, after a user turn, after an assistant turn
_NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}
_CLOSING = {"0": "", "s": "II", "u": "I", "a": ""}  # insertions that end the grammar's string
_ROLE = {"u": "user", "a": "assistant"}
_FAR = 1 << 60


# ---------------------------------------------------------------------------
# alignment of one run of turns
# ---------------------------------------------------------------------------
# A signature has a letter per turn that may stay: s, u, a or o (any other role),
# upper case if the turn is truncated.

def _keep_or_rerole(turn: str, letter: str) -> int:
    return (KEEP if turn.lower() == letter else REROLE) + (TRUNCATED if turn.isupper() else 0)


class _Ending:
    """Costs of aligning the turns from i on with the last r letters of the string that ends in ``last``."""

    def __init__(self, turns: str, last: str):
        self.turns, self.n = turns, len(turns)
        self.letters = (_NEXT[last], last)  # by r % 2
        n = self.n
        straight = [_keep_or_rerole(t, self.letters[(n - i) % 2]) for i, t in enumerate(turns)]
        incumbent = sum(straight) + INSERT  # with a letter inserted before, if the start asks for the other letter
        more, fewer = incumbent // INSERT, incumbent // DELETE
        self.low = [max(0, n - i - fewer) for i in range(n + 1)]
        self.rows: list[list[int]] = [[] for _ in range(n)] + [[0]]  # no insertion after the last turn
        for i in range(n - 1, -1, -1):
            low, below, low_below = self.low[i], self.rows[i + 1], self.low[i + 1]
            stay = [_keep_or_rerole(turns[i], x) for x in self.letters]
            row, size = [], len(below)
            for r in range(low, n - i + more + 1):
                at = r - low_below
                cost = below[at] + DELETE if 0 <= at < size else _FAR
                if r:
                    if 0 < at <= size and below[at - 1] + stay[r % 2] < cost:
                        cost = below[at - 1] + stay[r % 2]
                    if row and row[-1] + INSERT < cost:
                        cost = row[-1] + INSERT
                row.append(cost)
            self.rows[i] = row

    def cost(self, i: int, r: int) -> int:
        at = r - self.low[i]
        return self.rows[i][at] if 0 <= at < len(self.rows[i]) else _FAR

    def lengths(self, i: int, letter: str) -> Iterator[tuple[int, int]]:
        """(r, cost) of the strings of one letter or more that begin with ``letter``."""
        for at, cost in enumerate(self.rows[i]):
            r = at + self.low[i]
            if r and cost < _FAR and self.letters[r % 2] == letter:
                yield r, cost

    def audit(self, i: int, r: int) -> str:
        """The ASCII-least edits of least cost: Delete, Insert, Keep, Rerole."""
        out = []
        while i < self.n:
            cost = self.cost(i, r)
            if self.cost(i + 1, r) + DELETE == cost:
                out.append("D")
                i += 1
            elif r and self.cost(i, r - 1) + INSERT == cost:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.turns[i].lower() == self.letters[r % 2] else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def paths(turns: str) -> dict[tuple[str, str], tuple[int, str]]:
    """(cost, audit) of the best way from each state to each other, ending with the last turn's edit."""
    n = len(turns)
    best = {(p, p): (DELETE * n, "D" * n) for p in _STATES}
    if not n:
        return best
    system = [k for k, t in enumerate(turns) if t.lower() == "s"]

    def add(p: str, q: str, options: list[tuple[int, _Ending | None, int, int, str]]) -> None:
        """Options: cost, and the ending's place (i, r) from which the audit goes on after ``before``."""
        if not options:
            return
        least = min(o[0] for o in options)
        if (p, q) in best and best[p, q][0] < least:
            return
        audits = [before + (end.audit(i, r) if end else "") for cost, end, i, r, before in options if cost == least]
        if (p, q) in best and best[p, q][0] == least:
            audits.append(best[p, q][1])
        best[p, q] = least, min(audits)

    head = [(DELETE * k + KEEP + (TRUNCATED if turns[k].isupper() else 0), k) for k in system]
    add("0", "s", [(cost + DELETE * (n - 1 - k), None, 0, 0, "D" * k + "K" + "D" * (n - 1 - k)) for cost, k in head])
    for last in "ua":
        end = _Ending(turns, last)
        for p in _STATES:
            options = [(cost, end, 0, r, "") for r, cost in end.lengths(0, _NEXT[p])]
            if p == "0":
                options += [(cost + more, end, k + 1, r, "D" * k + "K") for cost, k in head
                            for r, more in end.lengths(k + 1, "u")]
            add(p, last, options)
    return best


def _whole(turns: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    ends = [(cost + INSERT * len(_CLOSING[q]), audit + _CLOSING[q])
            for (p, q), (cost, audit) in paths(turns).items() if p == "0"]
    return min(ends)


_remembered = lru_cache(maxsize=1 << 14)(_whole)


def best_repair(turns: str) -> tuple[int, str]:
    return _remembered(turns) if len(turns) <= 32 else _whole(turns)


def _walk(audit: str, lines: list[tuple[str, str]], state: str = "0") -> tuple[list[tuple[str, str]], str]:
    """The repaired turns that an audit (of the turns that may stay) makes, and the state it ends in."""
    out, rest = [], iter(lines)
    for edit in audit:
        role, text = next(rest) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K" and state == "0" and role[:1] == "s":
            state = "s"
        else:
            state = _NEXT[state]
            if edit != "K":
                role = _ROLE[state]
        out.append((role, text))
    return out, state


def _with_deleted(audit: str, gaps: list[int]) -> str:
    """The audit with the turns that had to go: ``gaps[i]`` of them after the i-th turn that may stay."""
    if not any(gaps):
        return audit
    out, i = ["D" * gaps[0]], 0
    for edit in audit:
        out.append(edit)
        if edit != "I":
            i += 1
            out.append("D" * gaps[i])
    return "".join(out)


class _Run:
    """A run of a conversation's rows, added in order: counts, signature and the lines that may stay."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.chars = self.rows = 0
        self.low = self.high = self.first_turn = self.last_turn = None
        self.first = self.last = None  # initials
        self.signature: list[str] = []
        self.lines: list[tuple[str, str]] = []
        self.gaps = [0]

    def add(self, turn: int | None, role: str, text: str, is_first: bool, copies: int) -> None:
        initial = role[:1]
        if turn is not None:
            if self.low is None:
                self.low = self.first_turn = turn
            if turn != self.high:
                self.turns += 1
            self.high = self.last_turn = turn
        if self.rows:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial
        self.illegal += copies - 1
        self.rows += 1
        self.chars += len(text)
        said = text.strip(_BLANK)
        if not said:
            self.blank += copies
            self.gaps[-1] += copies
            return
        if not is_first:
            self.duplicate += copies
            self.gaps[-1] += copies
            return
        cut = said[-1] not in ".!?"
        self.truncated += cut
        self.duplicate += copies - 1
        letter = initial if initial in ("s", "u", "a") else "o"
        self.signature.append(letter.upper() if cut else letter)
        self.lines.append((role, text))
        self.gaps.append(copies - 1)

    @property
    def must_go(self) -> int:
        return sum(self.gaps)


# ---------------------------------------------------------------------------
# on tables
# ---------------------------------------------------------------------------

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _rows_of(it, names: tuple[str, ...]):
    for b in it:
        yield from zip(*(b.column(c).to_pylist() for c in names))


def _short(emit_turns: bool):
    """Repair conversations that stand one after another, rows in order."""
    def fn(it):
        out, size = [], 0
        conv = run = seen = None

        def done():
            cost, audit = best_repair("".join(run.signature))
            turns = _walk(audit, run.lines)[0]
            if emit_turns:
                return [(conv, i, role, text) for i, (role, text) in enumerate(turns)]
            gaps = run.high - run.low + 1 - run.turns if run.turns else 0
            digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
            return [(conv, gaps, run.blank, run.duplicate, run.truncated, run.illegal, cost + DELETE * run.must_go,
                     _with_deleted(audit, run.gaps), digest)]

        for c, turn, role, text, present in _rows_of(it, ("conv", "turn", "role", "text", "present")):
            if run is None or c != conv:
                if run is not None:
                    out += done()
                    size += run.chars + 1000
                    if size > 4 << 20:
                        yield out
                        out, size = [], 0
                conv, run, seen = c, _Run(), set()
            if present:
                run.add(turn, role, text, (role, text) not in seen, 1)
                seen.add((role, text))
        if run is not None:
            out += done()
        if out:
            yield out
    return fn


def _cut(it):
    """Blocks of long conversations with their paths between the states."""
    part, number = TaskContext.get().partitionId(), 0
    conv, run = None, None

    def done():
        nonlocal number
        number += 1
        found = paths("".join(run.signature))
        costs, ranks, audits = [], [], []
        for p in _STATES:
            mine = [found.get((p, q), (-1, "")) for q in _STATES]
            order = sorted(range(4), key=lambda j: mine[j][1])
            costs += [c for c, _ in mine]
            ranks += [order.index(j) for j in range(4)]
            audits += [a for _, a in mine]
        return (conv, part, number, run.low, run.high, run.first_turn, run.last_turn, run.turns, run.blank, run.duplicate,
                run.truncated, run.illegal, run.first, run.last, costs, ranks, audits, run.gaps,
                [{"role": r, "text": t} for r, t in run.lines])

    for c, turn, role, text, is_first, copies in _rows_of(it, ("conv", "turn", "role", "text", "is_first", "copies")):
        if run is not None and (c != conv or run.rows >= BLOCK_ROWS or run.chars >= BLOCK_CHARS):
            yield [done()]
            run = None
        if run is None:
            conv, run = c, _Run()
        run.add(turn, role, text, is_first, copies)
    if run is not None:
        yield [done()]


_BLOCK = ("part long, block long, low long, high long, first_turn long, last_turn long, turns long, blank long, "
          "duplicate long, truncated long, illegal long, first string, last string, costs array<long>, ranks array<long>, "
          "audits array<string>, gaps array<long>, lines array<struct<role: string, text: string>>")


def _chain(it):
    """The way through each conversation's blocks: which state each block starts and ends in."""
    conv, blocks = None, None

    def done():
        left = [INSERT * len(_CLOSING[q]) for q in _STATES]  # least cost from each state after the block
        after = [left]
        for _, _, costs, _ in reversed(blocks[1:]):
            left = [min((costs[4 * p + q] + left[q] for q in range(4) if costs[4 * p + q] >= 0), default=_FAR) for p in range(4)]
            after.append(left)
        p, rows = 0, []
        for (part, number, costs, ranks), left in zip(blocks, reversed(after)):
            _, _, q = min((costs[4 * p + q] + left[q], ranks[4 * p + q], q) for q in range(4) if costs[4 * p + q] >= 0)
            rows.append((part, number, 4 * p + q))
            p = q
        return [(*r, _CLOSING[_STATES[p]] if i == len(rows) - 1 else "") for i, r in enumerate(rows)]

    for c, part, number, costs, ranks in _rows_of(it, ("conv", "part", "block", "costs", "ranks")):
        if blocks is None or c != conv:
            if blocks is not None:
                yield done()
            conv, blocks = c, []
        blocks.append((part, number, costs, ranks))
    if blocks is not None:
        yield done()


def _finish(emit_turns: bool):
    """Sum up and hash conversations whose blocks stand in order."""
    names = ("conv", "part", "block", "low", "high", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated",
             "illegal", "first", "last", "gaps", "lines", "cost", "start", "audit", "closing")

    def fn(it):
        conv, sums, audits, digest = None, None, [], None
        for row in _rows_of(it, names):
            b = dict(zip(names, row))
            lines = [(x["role"], x["text"]) for x in b["lines"]]
            turns, state = _walk(b["audit"], lines, _STATES[b["start"]])
            turns += _walk(b["closing"], [], state)[0]
            if emit_turns:
                yield [(b["conv"], (b["part"] << 40) + (b["block"] << 20) + i, r, t) for i, (r, t) in enumerate(turns)]
                continue
            if sums is None or b["conv"] != conv:
                if sums is not None:
                    yield [_summed(conv, sums, audits, digest)]
                conv, audits, digest = b["conv"], [], hashlib.sha256()
                sums = {"low": None, "high": None, "last_turn": None, "turns": 0, "last": None, "empty": True,
                        **dict.fromkeys(_COUNTS[1:], 0)}
            for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                sums[c] += b[c]
            if sums["last"] is not None:
                sums["illegal"] += sums["last"] + b["first"] not in ("su", "ua", "au")
            if b["turns"]:
                sums["turns"] -= sums["last_turn"] == b["first_turn"]
                sums["low"] = b["low"] if sums["low"] is None else sums["low"]
                sums["high"], sums["last_turn"] = b["high"], b["last_turn"]
            sums["last"] = b["last"]
            sums["cost"] += DELETE * sum(b["gaps"]) + INSERT * len(b["closing"])
            audits.append(_with_deleted(b["audit"], b["gaps"]) + b["closing"])
            if turns:
                text = "\n".join(f"{r}:{t}" for r, t in turns)
                digest.update((text if sums["empty"] else "\n" + text).encode("utf-8", "surrogatepass"))
                sums["empty"] = False
        if sums is not None:
            yield [_summed(conv, sums, audits, digest)]
    return fn


def _summed(conv, s: dict, audits: list[str], digest) -> tuple:
    gaps = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
    return conv, gaps, *(s[c] for c in _COUNTS[1:]), "".join(audits), digest.hexdigest()


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``arrow_map`` for a function that yields lists of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship = df.sparkSession.createDataFrame([], schema).schema
    names = ship.fieldNames()

    def task(it):
        arrow = to_arrow_schema(ship)
        for rows in fn(it):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], names)

    return arrow_map(df, task, schema)


def _order() -> list[Column]:
    return [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _run(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: str | None,
         emit_turns: bool) -> DataFrame:
    space = F.lit(" ")
    here = F.lit(True) if present is None else F.coalesce(conversations[present], F.lit(False))
    rows = pick(conversations, conv=conv_col, turn=conversations[turn_col].cast("long"),
                role=F.coalesce(conversations[role_col], space), text=F.coalesce(conversations[text_col], space), present=here)
    kind = rows.schema["conv"].dataType.simpleString()
    result = (f"conv {kind}, place long, role string, text string" if emit_turns else
              f"conv {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")
    size = rows.groupBy("conv").agg(F.count(F.when(F.col("present"), 1)).alias("n"),
                                    F.sum(F.when(F.col("present"), F.length("text"))).alias("chars"))
    long = stored(size.where((F.col("n") > SHORT_ROWS) | (F.col("chars") > SHORT_CHARS)).select(F.col("conv").alias("c")),
                  "long-conversations")
    if long.isEmpty():
        return _map(rows.repartition("conv").sortWithinPartitions(*_order()), _short(emit_turns), result)
    is_long = rows["conv"].eqNullSafe(long["c"])
    # a row that is not present names its conversation only if that has none
    brief = rows.join(long, is_long, "left_anti").repartition("conv").sortWithinPartitions(*_order())
    return _map(brief, _short(emit_turns), result).unionByName(
        _long(rows.where("present").join(long, is_long, "left_semi"), kind, result, emit_turns))


def _long(rows: DataFrame, kind: str, result: str, emit_turns: bool) -> DataFrame:
    counted = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    name = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    counted = stored(counted.withColumn("name", name), "counted-turns")
    again = counted.groupBy(F.col("conv").alias("c"), F.col("name").alias("m")).agg(
        F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = stored(again, "repeated-turns")
    first = F.col("first").isNull() | F.col("turn").eqNullSafe(F.col("first.turn"))
    marked = counted.join(again, counted["conv"].eqNullSafe(again["c"]) & (counted["name"] == again["m"]), "left").select(
        "conv", "turn", "role", "text", "copies", first.alias("is_first"))
    dealt = marked.repartitionByRange(F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64))
    blocks = stored(_map(dealt.sortWithinPartitions(*_order()), _cut, f"conv {kind}, {_BLOCK}"), "turn-blocks")
    order = blocks.select("conv", "part", "block", "costs", "ranks").repartition("conv").sortWithinPartitions("conv", "part", "block")
    way = stored(_map(order, _chain, "part long, block long, way long, closing string"), "ways")
    taken = blocks.join(way, ["part", "block"]).withColumn("start", F.floor(F.col("way") / 4)) \
        .withColumn("cost", F.col("costs")[F.col("way").cast("int")]).withColumn("audit", F.col("audits")[F.col("way").cast("int")]) \
        .drop("costs", "ranks", "audits", "way")
    if not emit_turns:
        taken = taken.repartition("conv").sortWithinPartitions("conv", "part", "block")
    return _map(taken, _finish(emit_turns), result)


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", present: str | None = None) -> DataFrame:
    """One row per conversation: conv, its counts of gaps and faults, the repair's cost and audit, and the SHA-256 of
    the repaired turns (``role:text``, joined by line feeds). Rows whose ``present`` column is not true only name
    their conversation."""
    return _run(conversations, conv_col, turn_col, role_col, text_col, present, False)


def repaired_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", present: str | None = None) -> DataFrame:
    """The turns of the repaired conversations: conv, place (ascending within a conversation), role, text."""
    return _run(conversations, conv_col, turn_col, role_col, text_col, present, True)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Rows damaged by the rest of crc32(``conv_id:turn``) by 20: 0 drops the row (it is not ``present``), 1 empties its
    text, 2 removes its full stops, question and exclamation marks, 3 repeats it, 4 makes its role user. Nulls are one space."""
    text = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col))), F.lit(20))
    rows = pick(conversations, conv_id=conv_col, turn=turn_col, role=text(role_col), text=text(text_col), k=k)
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("k").isin(0, 1), F.lit("")).when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), (F.col("k") != 0).alias("present"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")

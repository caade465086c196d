"""Conversation repair against an independent shortest-path search, short and cut conversations alike."""
import hashlib
import itertools
import random
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from colloquy.llm import queries, turn_repair as R

sys.setrecursionlimit(20_000)
NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}


def _search(turns):
    """(cost, audit) by trying every edit from every (turn, state)."""
    @lru_cache(None)
    def best(i, state, inserted):
        options = []
        if i == len(turns) and state in "0a":
            options.append((0, ""))
        if inserted < 2:
            c, a = best(i, NEXT[state], inserted + 1)
            options.append((c + 2, "I" + a))
        if i < len(turns):
            t = turns[i]
            c, a = best(i + 1, state, 0)
            options.append((c + 3, "D" + a))
            if t != "-":
                low, cut = t.lower(), int(t.isupper())
                if low == "s" and state == "0":
                    c, a = best(i + 1, "s", 0)
                    options.append((c + cut, "K" + a))
                c, a = best(i + 1, NEXT[state], 0)
                options.append((c + cut, "K" + a) if low == NEXT[state] else (c + cut + 2, "R" + a))
        return min(options, default=(10 ** 9, ""))
    return best(0, "0", 0)


def _brute(rows):
    """The contract, row by row, for the rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marks, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        fault = ("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        low = role[:1] if role[:1] in ("s", "u", "a") else "o"
        marks.append("-" if fault in ("blank", "duplicate") else low.upper() if fault else low)
    cost, audit = _search("".join(marks))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    out, state, rest = [], "0", iter(rows)
    for e in audit:
        _, role, text = next(rest) if e != "I" else (None, "", "")
        if e == "D":
            continue
        if e == "K" and state == "0" and role[:1] == "s":
            state = "s"
        else:
            state = NEXT[state]
            role = role if e == "K" else {"u": "user", "a": "assistant"}[state]
        out.append(f"{role}:{text}")
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def _hurt(rows):
    """Damage as the query's contract says, by Python's crc32."""
    out = {}
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        mine = out.setdefault(conv, [])
        if k == 1:
            text = ""
        if k == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if k == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def test_every_short_signature_matches_the_search():
    for n in range(5):
        for turns in itertools.product("suaoSUAO", repeat=n):
            assert R.best_repair("".join(turns)) == _search("".join(turns)), turns


def test_long_signatures_match_the_search():
    rng = random.Random(4)
    for _ in range(300):
        turns = "".join(rng.choice("uauauasoUAO") for _ in range(rng.randint(5, 60)))
        assert R._whole(turns) == _search(turns), turns


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op11_turn_repair(spark, sf).collect()}
    assert got == {c: _brute(r) for c, r in _hurt(rows).items()}


_SCHEMA = "conv_id long, turn long, role string, text string, place string, conv string, c int"


def _odd_rows():
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "", None, "tool", "unicorn"]
    texts = ["Yes.", "No!", "perhaps", "", None, " \t", "Why?  ", "x" * 50_000, "Line one.\nLine two"]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(12)]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts) )
            for _ in range(60)]
    rows += [(7, t, "user" if t % 2 else "assistant", f"Turn {t % 40}." if t % 7 else "cut off") for t in range(700)]  # a long one
    rows += [(8, 1, "user", "the same row.")] * 400 + [(9, None, "user", None)] * 3
    return [(*r, "p", "c", 5) for r in rows]


@pytest.mark.parametrize("block_rows", [256, 16])
def test_odd_and_long_conversations(spark, monkeypatch, block_rows):
    monkeypatch.setattr(R, "BLOCK_ROWS", block_rows)
    rows = _odd_rows()
    df = spark.createDataFrame(rows, _SCHEMA).repartition(5)
    plain = {}
    for conv, turn, role, text, *_ in rows:
        plain.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {c: _brute(r) for c, r in plain.items()}
    for limit in (256, 0):  # by their size, and all of them cut into blocks
        monkeypatch.setattr(R, "SHORT_ROWS", limit)
        got = {r[0]: tuple(r)[1:] for r in R.repair(df).collect()}
        assert got == want
        turns = {}
        for r in sorted(R.repaired_turns(df).collect(), key=lambda r: r["place"]):
            turns.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
        assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", "Well. Done!") for c in range(60) for t in range(1, 3)]
    rows += [(None, 1, None, "a."), (None, None, "user", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in R.repair(R.damaged(df), present="present").collect()}
    hurt = _hurt(rows)
    assert got == {c: _brute(hurt.get(c, [])) for c in {r[0] for r in rows}}
    none = R.repair(R.damaged(df.where("conv_id < 0")), present="present")
    assert none.count() == 0
    gone = df.where("conv_id IS NOT NULL").where(F.pmod(F.crc32(F.concat_ws(":", "conv_id", "turn")), F.lit(20)) == 0)
    assert {tuple(r)[1:] for r in R.repair(R.damaged(gone), present="present").collect()} == {
        (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}

"""Token ids of whole texts, with a cache of the pieces that repeat.

The public vocabularies used here never join characters across a single
space or line feed between two other characters, nor a letter or digit with a
full stop or comma after it. Texts are cut at such places, found on their
UTF-8 bytes; pieces are looked up by a 64-bit hash and compared byte by byte
(texts with two pieces of one hash are encoded as a whole); each distinct piece is
encoded by the ``tokenizers`` library once and remembered, and the ids of a
text are those of its pieces in a row. ``tests/llm`` compares them with plain
``encode`` calls. A cut that is left out (other white space, other scripts'
white space near by) only makes a piece longer.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from colloquy.llm.spans import EXACT, joined, numbers, same_spans, sorted_distinct, span_hashes

#: Pieces that a worker remembers at most (some 40 bytes each); then it starts anew.
CACHE_PIECES = 1_000_000
#: Bytes of texts that are cut and looked up at a time.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# bytes that white space beyond ASCII begins with
_MAY_START_SPACE = _SPACE.copy()
_MAY_START_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def tokenizer_json(path: str) -> str:
    """The tokenizer file's text, read on the driver and sent with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def cuts(raw: np.ndarray) -> np.ndarray:
    """Positions in UTF-8 bytes where a text may be cut."""
    at = np.flatnonzero((raw[1:-1] == 32) | (raw[1:-1] == 10)) + 1 if len(raw) > 2 else np.empty(0, dtype=np.int64)
    before, after = raw[at - 1], raw[at + 1]
    good = ~_SPACE[before] & ~_MAY_START_SPACE[after]
    # the character before ends in a byte over 127: its first byte tells whether it can be white space
    wide = np.flatnonzero(good & (before > 127))
    if len(wide):
        back = at[wide]
        lead = raw[np.maximum(back - 2, 0)]
        for k in (3, 4):
            lead = np.where(lead < 0xC0, raw[np.maximum(back - k, 0)], lead)
        good[wide[_MAY_START_SPACE[lead] | (lead < 0xC0)]] = False
    dots = np.flatnonzero((raw[1:] == 46) | (raw[1:] == 44)) + 1 if len(raw) > 1 else np.empty(0, dtype=np.int64)
    letter = _ALNUM[raw[dots - 1]]
    two = raw[np.maximum(dots - 2, 0)]
    letter |= (two == 0xC3) & (raw[dots - 1] != 0x97) & (raw[dots - 1] != 0xB7)  # À to ÿ without × and ÷
    return sorted_distinct(at[good], dots[letter])


class _Grown:
    """An array that is appended to in place, with room to spare."""

    def __init__(self, dtype):
        self.data, self.used = np.zeros(1 << 12, dtype=dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.used + len(values) + 16
        if need > len(self.data):
            self.data = np.concatenate((self.data, np.zeros(need, dtype=self.data.dtype)))
        self.data[self.used:self.used + len(values)] = values
        self.used += len(values)


class PieceEncoder:
    """Encode texts to ``uint32`` id arrays, exactly as ``Tokenizer.encode`` does."""

    def __init__(self, json_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(json_text)
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.empty(0, dtype=np.uint64)  # ascending
        self._slots = np.empty(0, dtype=np.int32)  # where the rest about a piece stands
        # its ids: first place, number; its bytes: first place, number; all ids and all bytes in a row
        self._start, self._size, self._flat = _Grown(np.int64), _Grown(np.int64), _Grown("<u4")
        self._from, self._bytes, self._raw = _Grown(np.int64), _Grown(np.int64), _Grown(np.uint8)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self._hashes, hashes)
        known = at < len(self._hashes)
        known[known] = self._hashes[at[known]] == hashes[known]
        return at, known

    def _learn(self, hashes: np.ndarray, raws: list[bytes]) -> None:
        pieces = [r.decode("utf-8", "surrogatepass") for r in raws]
        found = [e.ids for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.array([len(x) for x in found], dtype=np.int64)
        length = np.array([len(r) for r in raws], dtype=np.int64)
        where = np.searchsorted(self._hashes, hashes)
        self._hashes = np.insert(self._hashes, where, hashes)
        self._slots = np.insert(self._slots, where, np.arange(self._start.used, self._start.used + len(size), dtype=np.int32))
        self._start.add(self._flat.used + np.cumsum(size) - size)
        self._size.add(size)
        self._flat.add(np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(size.sum())))
        self._from.add(self._raw.used + np.cumsum(length) - length)
        self._bytes.add(length)
        self._raw.add(np.frombuffer(b"".join(raws), dtype=np.uint8))

    def _plain(self, texts: list[str | None]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _chunk(self, texts: list[str | None]) -> list[np.ndarray]:
        raw, offsets = joined(texts)
        # pieces end at cuts and at texts' ends; the line feed after a text belongs to none
        inner = cuts(raw)
        edges = offsets[1:] - 1
        outside = np.zeros(len(raw) + 1, dtype=bool)
        outside[edges] = outside[offsets] = True
        inner = inner[~outside[inner]]
        starts = sorted_distinct(inner, offsets[:-1][edges > offsets[:-1]])
        ends = np.minimum(np.append(starts[1:], len(raw)), edges[np.searchsorted(offsets, starts, side="right") - 1])
        hashes = span_hashes(raw, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._hashes) + len(distinct) > CACHE_PIECES:
            self._forget()
        at, known = self._find(distinct)
        length = ends - starts
        # pieces of one hash against the first of them, and this against the piece remembered
        chosen, old = first[which], first[known]
        long, old_long = np.flatnonzero((length > EXACT) & (chosen != np.arange(len(chosen)))), length[old] > EXACT
        slot, mine = self._slots[at[known]], numbers(raw)
        same = ((length == length[chosen]).all() and (length[old] == self._bytes.data[slot]).all()
                and same_spans(mine, starts[long], mine, starts[chosen[long]], length[long])
                and same_spans(mine, starts[old[old_long]], numbers(self._raw.data, self._raw.used),
                               self._from.data[slot[old_long]], length[old[old_long]]))
        if not same:
            return self._plain(texts)
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            self._learn(distinct[new], [data[starts[i]:ends[i]] for i in first[new]])
        slot = self._slots[self._find(distinct)[0]]
        size = self._size.data[slot][which]
        # ids of all pieces in a row: each one's stretch of the flat store
        before = np.cumsum(size) - size
        ids = self._flat.data[np.repeat(self._start.data[slot][which] - before, size) + np.arange(int(size.sum()))]
        total = np.concatenate(([0], np.cumsum(size)))
        bounds = total[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """One id array per text; null and empty texts have none."""
        out: list[np.ndarray] = []
        held: list[str | None] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= CHUNK_BYTES:
                out += self._chunk(held)
                held, size = [], 0
        return out + (self._chunk(held) if held else [])


_encoders: dict[int, PieceEncoder] = {}


def encoder(json_text: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer; kept from task to task."""
    key = hash(json_text)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(json_text)
    return _encoders[key]

"""Token files: one zstandard frame per document, with a shared dictionary.

The id arrays of short documents are too small to compress alone, so a
dictionary is trained on serialized id arrays of a bounded sample and used by
every frame. A file holds, in this order:

* ``TKZ1`` and the length of a JSON header (little-endian uint32),
* the header: the SHA-256 of the dictionary, bytes per id, number of documents,
* the frames, one per document, each decompressed by itself,
* the index: per document its id (int64), whether the id is null (uint8), its
  number of tokens (uint32), and the frames' offsets (uint64, one more than
  documents, from the file's start),
* the index's offset (uint64) and ``TKZ1``.

The dictionary lies beside the files, named by its SHA-256; a reader checks
it. One document is fetched by reading the footer, the index and one frame.

Files are written by tasks over ranges of the sorted ids. The manifest (one
row per file) says how many tokens a file holds, so a document's position in
the whole stream is the sum of the files before it plus its place in its own.

Defined results: a null or empty text has only the end id; null ids come
first; rows that repeat an id stand next to each other in order of their
texts; an empty table gives no files and an empty table. Other than integer
ids are refused.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import arrow_map, batches, file_size, new_folder, pick, read_bytes, stored, write_bytes
from colloquy.llm.tokens import encoder, tokenizer_json

MAGIC = b"TKZ1"
#: The dictionary is trained on about so many documents, of at most so many
#: characters each, chosen by hash; its size in bytes.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1500, 8000, 64 << 10
#: A file is closed when its frames reach this size.
FILE_BYTES = 16 << 20
LEVEL = 3


def _width(json_text: str) -> int:
    """Bytes per id: 2 if every id of the vocabulary fits."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_str(json_text).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, json_text: str, end_id: int, width: int) -> bytes:
    """A zstandard dictionary from a sample of serialized id arrays; empty if there are too few."""
    import zstandard

    n = docs.count()
    share = int(min(1.0, SAMPLE_DOCS / max(1, n)) * (1 << 30))
    rows = docs.where(F.length("text").between(1, SAMPLE_CHARS)
                      & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= share)).select("text")

    def serialized(it):
        enc = encoder(json_text)
        for b in batches(it):
            ids = enc.encode_many(b.column("text").to_pylist())
            raw = [np.append(x, np.uint32(end_id)).astype(f"<u{width}").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["raw"])

    samples = sorted(bytes(r[0]) for r in arrow_map(rows, serialized, "raw binary").limit(2 * SAMPLE_DOCS).collect())
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8 + 1024), samples).as_bytes()
    except zstandard.ZstdError:  # too little data for a dictionary
        return b""


class _FileWriter:
    def __init__(self, folder: str, part: int, dictionary: bytes, width: int):
        import zstandard

        self.folder, self.part, self.width, self.seq = folder, part, width, 0
        self.sha = hashlib.sha256(dictionary).hexdigest()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        self._new()

    def _new(self):
        self.frames, self.size, self.ids, self.counts, self.lengths = [], 0, [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.zstd.compress(ids.astype(f"<u{self.width}").tobytes())
        self.frames.append(frame)
        self.size += len(frame)
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.lengths.append(len(frame))

    def close(self) -> list[tuple]:
        """Write what was added as a file; its row of the manifest."""
        if not self.frames:
            return []
        header = json.dumps({"dictionary": self.sha, "id_bytes": self.width, "documents": len(self.ids)}).encode()
        first = 8 + len(header)
        offsets = np.concatenate(([first], first + np.cumsum(self.lengths))).astype("<u8")
        index = [np.array([i or 0 for i in self.ids], dtype="<i8").tobytes(),
                 np.array([i is None for i in self.ids], dtype="u1").tobytes(),
                 np.array(self.counts, dtype="<u4").tobytes(), offsets.tobytes()]
        path = f"{self.folder}/ids-{self.part:06d}-{self.seq:05d}.tkz"
        write_bytes(path, b"".join([MAGIC, struct.pack("<I", len(header)), header, *self.frames, *index,
                                    struct.pack("<Q", int(offsets[-1])), MAGIC]))
        row = (self.part, self.seq, path, len(self.ids), sum(self.counts))
        self.seq += 1
        self._new()
        return [row]


def write(documents: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Write the ids of all documents in ascending id order; returns the manifest
    (part, seq, path, documents, tokens), one row per file."""
    spark = documents.sparkSession
    if not isinstance(documents.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError("token files hold integer document ids")
    folder = folder or new_folder(spark, "tokens")
    docs = pick(documents, doc_id=documents[id_col].cast("long"), text=text_col)
    json_text = tokenizer_json(tokenizer)
    width = _width(json_text)
    dictionary = train_dictionary(docs, json_text, end_id, width)
    write_bytes(f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.zdict", dictionary)
    model = spark.sparkContext.broadcast((json_text, dictionary))  # some 2 MB

    def write_files(it):
        from pyspark import TaskContext

        json_text, dictionary = model.value
        enc = encoder(json_text)
        out = _FileWriter(folder, TaskContext.get().partitionId(), dictionary, width)
        rows = []
        for b in batches(it):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode_many(b.column("text").to_pylist())):
                out.add(doc_id, np.append(ids, np.uint32(end_id)))
                if out.size >= FILE_BYTES:
                    rows += out.close()
        rows += out.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)],
                                             ["part", "seq", "path", "documents", "tokens"])

    ranges = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(arrow_map(ranges, write_files, "part long, seq long, path string, documents long, tokens long"),
                  "token-manifest")


class TokenFile:
    """One file, for reading single documents (``whole`` false: only the header, the index and the documents
    asked for are read) or all of them."""

    def __init__(self, path: str, whole: bool = True):
        import zstandard

        self.path = path
        raw = read_bytes(path) if whole else None
        part = (lambda a, n: raw[a:a + n]) if whole else (lambda a, n: read_bytes(path, a, n))
        length = len(raw) if whole else file_size(path)
        head, tail = part(0, 8), part(length - 12, 12)
        if head[:4] != MAGIC or tail[-4:] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.header = json.loads(part(8, struct.unpack("<I", head[4:])[0]))
        dictionary = read_bytes(f"{path.rsplit('/', 1)[0]}/{self.header['dictionary']}.zdict")
        if hashlib.sha256(dictionary).hexdigest() != self.header["dictionary"]:
            raise ValueError(f"the dictionary of {path} was changed")
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        n, at = self.header["documents"], struct.unpack("<Q", tail[:8])[0]
        index = part(at, length - 12 - at)
        ids = np.frombuffer(index, dtype="<i8", count=n).tolist()
        nulls = np.frombuffer(index, dtype="u1", count=n, offset=8 * n)
        self.doc_ids = [None if z else i for i, z in zip(ids, nulls)]
        self.counts = np.frombuffer(index, dtype="<u4", count=n, offset=9 * n).astype(np.int64)
        self.offsets = np.frombuffer(index, dtype="<u8", count=n + 1, offset=13 * n).astype(np.int64)
        self.part = part

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        width = self.header["id_bytes"]
        frame = self.part(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))
        return np.frombuffer(self.zstd.decompress(frame, max_output_size=int(self.counts[k]) * width), dtype=f"<u{width}")


def document(path: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of a document (of each row under that id) of one file, by ranged reads."""
    f = TokenFile(path, whole=False)
    return [f.ids(k) for k, i in enumerate(f.doc_ids) if i == doc_id]


def read(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read all files back: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids.

    The manifest has a row per file, so its running sum is small; the files are
    then dealt out to tasks one by one.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = stored(manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("path", "first"),
                   "token-files")
    n = files.count()

    def read_files(it):
        for b in it:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist()):
                f = TokenFile(path)
                starts = first + np.concatenate(([0], np.cumsum(f.counts)))[:-1]
                for at in range(0, len(f.doc_ids), 500):
                    to = min(at + 500, len(f.doc_ids))
                    ids = [f.ids(k).astype("<u4") for k in range(at, to)]
                    cols = [pa.array(f.doc_ids[at:to], pa.int64()), pa.array(starts[at:to], pa.int64()),
                            pa.array(f.counts[at:to], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return arrow_map(files.repartition(max(1, n)), read_files, schema)

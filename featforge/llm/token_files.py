"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A file holds some documents in ascending order. Layout, all little-endian, in this order:

    magic   8 bytes  b"TOKIDS01"
    head    8 x 8    documents, documents with a null id (they come first), smallest id, ids in all, bytes an id (2 or 4),
                     bytes of the boundary section, bytes of the document-id section, 0
    bounds  the documents + 1 boundaries, Elias-Fano coded
    docs    document ids less the smallest, Elias-Fano coded
    ids     the token ids of all documents in a row

An Elias-Fano section: values, low bits a value, upper bound (3 x 8 bytes), low bits packed, high bits as a bit vector with
a one for each value, and the position of every 64th one as 32-bit numbers. Value i is (select(i) - i) high bits and its
low bits, so a boundary costs 2 + log2(ids / documents) bits, and finding it reads one sample and a few words.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featforge.llm.tokens import encoded

MAGIC = b"TOKIDS01"
_EVERY = 64
_MANIFEST = "part int, seq int, name string, n_docs bigint, n_ids bigint"


def pack_sorted(values: np.ndarray) -> bytes:
    """Elias-Fano section of ascending non-negative integers below 2**63."""
    values = np.asarray(values, np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    lows = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    return (struct.pack("<3Q", n, low, top) + np.packbits(lows, bitorder="little").tobytes()
            + np.packbits(high, bitorder="little").tobytes() + ones[::_EVERY].astype("<u4").tobytes())


class Sorted:
    """Reader of an Elias-Fano section."""

    def __init__(self, data: bytes | memoryview):
        self.n, self.low, top = struct.unpack_from("<3Q", data)
        lows = -(-self.n * self.low // 8)
        highs = -(-((top >> self.low) + self.n) // 8) if self.n else 0
        self._lows = np.frombuffer(data, np.uint8, lows, 24)
        self._high = np.frombuffer(data, np.uint8, highs, 24 + lows)
        self._samples = np.frombuffer(data, "<u4", -(-self.n // _EVERY), 24 + lows + highs)

    def __len__(self) -> int:
        return self.n

    def _one(self, i: int) -> int:
        """Position of the i-th one: on from the sample before it, a few bytes at a time."""
        at, left = int(self._samples[i // _EVERY]), i % _EVERY
        while True:
            stop = (at // 8 + 16) * 8
            ones = np.flatnonzero(np.unpackbits(self._high[at // 8:stop // 8], bitorder="little")[at % 8:])
            if left < len(ones):
                return at + int(ones[left])
            left, at = left - len(ones), stop

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.low
        bits = np.unpackbits(self._lows[first // 8:-(-(first + self.low) // 8)], bitorder="little")[first % 8:][:self.low]
        return (self._one(i) - i) << self.low | sum(int(b) << k for k, b in enumerate(bits))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[:self.n].astype(np.uint64)
        bits = np.unpackbits(self._lows, bitorder="little")[:self.n * self.low].reshape(self.n, self.low)
        low = (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return ((ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)) | low


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file; ``doc_ids`` ascend with nulls first."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    width = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    bounds = pack_sorted(np.concatenate(([0], np.cumsum(counts))))
    names = pack_sorted(np.array([d - first for d in known], np.uint64))
    head = struct.pack("<2QqQ4Q", len(doc_ids), len(doc_ids) - len(known), first, len(ids), width, len(bounds), len(names), 0)
    return MAGIC + head + bounds + names + ids.astype(f"<u{width}").tobytes()


class TokenFile:
    """Reader of one file: ``offset(i)``, ``document(i)``, ``doc_ids()``."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token-id file")
        n, nulls, first, total, width, bounds, names, _ = struct.unpack_from("<2QqQ4Q", data, 8)
        data = memoryview(data)
        self.n, self._nulls, self._first, at = n, nulls, first, 8 + 64
        self.bounds = Sorted(data[at:at + bounds])
        self._names = Sorted(data[at + bounds:at + bounds + names])
        self.ids = np.frombuffer(data, f"<u{width}", total, at + bounds + names)

    def __len__(self) -> int:
        return self.n

    def offset(self, i: int) -> int:
        return self.bounds[i]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i]:self.bounds[i + 1]]

    def doc_ids(self) -> list[int | None]:
        return [None] * self._nulls + [int(v) + self._first for v in self._names.all()]


def _open(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, file_ids: int = 1 << 25,
                      text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenize whole texts and write them in ascending key order under ``folder``; returns the manifest, one row a file.

    ``folder`` must be reachable by all executors. Rows are dealt by ranges of the key, sorted, and written in files of
    about ``file_ids`` ids (a longer document has a file of its own), each under a passing name first, so a task that
    runs again replaces its files by equal ones. Nulls come first; equal keys are ordered by their text. A null or
    empty text has the end id alone. No rows give an empty manifest. Other columns are not read.
    """
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    rows = rows.repartitionByRange(int(n), "k").sortWithinPartitions("k", F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        store, root = _open(folder)
        names, counts, parts, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}.tok"
            passing = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(passing) as out:
                out.write(file_bytes(names, np.array(counts), np.concatenate(parts)))
            store.move(passing, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([name]),
                                               pa.array([len(names)]), pa.array([total])],
                                              ["part", "seq", "name", "n_docs", "n_ids"])

        for batch in batches:
            for first, ids, at in encoded(batch.column(1), tokenizer):
                if end_id is not None:
                    ids, at = np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
                keys = batch.column(0).slice(first, len(at) - 1).to_pylist()
                if total and total + len(ids) > file_ids:
                    yield flush()
                    names, counts, parts, total, seq = [], [], [], 0, seq + 1
                names += keys
                counts += np.diff(at).tolist()
                parts.append(ids)
                total += len(ids)
        if names:
            yield flush()

    _open(folder)[0].create_dir(_open(folder)[1])
    rows.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files in order, each with ``base``: the ids in all files before it. One row a file, so one window is enough."""
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").selectExpr(
        "*", "sum(n_ids) over (order by part, seq) - n_ids as base")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit) from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['name']}") as f:
                    file = TokenFile(f.read())
                edges, keys = file.bounds.all().astype(np.int64), file.doc_ids()
                at = 0
                while at < len(file):  # some documents at a time, of about a million ids
                    to = max(at + 1, int(np.searchsorted(edges, edges[at] + (1 << 20), "right")) - 1)
                    ids = file.ids[edges[at]:edges[to]].astype("<u4")
                    cuts = ((edges[at:to + 1] - edges[at]) * 4).astype(np.int64)
                    raw = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at:to], pa.int64()), pa.array(edges[at:to] + row["base"]),
                         pa.array(np.diff(edges[at:to + 1])), raw.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                    at = to

    files = read_manifest(spark, folder).select("name", "base")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "name").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")

"""Rows of tables too large to send to every task, looked up for blocks of a scan by their 64-bit keys.

A task of a scan asks once for all distinct keys of a block. Keys are mixed and dealt into slices by their upper bits, so
that no key or context is a hot one; the slices of the tables meet the questions in one shuffle of packed rows, and the answers of a
block are saved under the name of the block, a digest of its keys, where a second scan of the same rows finds them. Every key
of the tables is there to be found; a task holds a slice of a table, and the answers to a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featforge.llm import text as X
from featforge.session import same_splits, scratch_path

#: Rows of a slice, about, and rows of a table that a task packs at once.
SLICE = 1 << 17
PACKED = 1 << 20
_ROWS = "kind int, slice int, block string, keys binary, found binary, values binary"
_NAMES = ["kind", "slice", "block", "keys", "found", "values"]
_BACK = [np.uint64(pow(k, -1, 1 << 64)) for k in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def unmix(h: np.ndarray) -> np.ndarray:
    """What ``text.mix`` made the numbers of."""
    for shift, back in zip((31, 27, 30), (*_BACK, None)):
        h = h ^ (h >> np.uint64(shift)) ^ (h >> np.uint64(2 * shift))
        h = h if back is None else h * back
    return h


def pack(keys: np.ndarray) -> bytes:
    """Ascending numbers, as the first one and as many bytes of each step as the largest needs."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(steps) + 1, 8), np.uint8)
    out[1:, :width] = steps
    out = out.view(np.uint64).ravel()
    out[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    return np.cumsum(out, dtype=np.uint64)


def _slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(slice, low, high) of the slices that ascending mixed keys stand in."""
    of = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
    yield from ((int(of[low]), low, high) for low, high in zip(edges[:-1], edges[1:]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], _NAMES)


def _packed(table: DataFrame, kind: int, bits: int) -> DataFrame:
    """The rows of ``table`` (key, then float columns) in packed rows of slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            keys = X.mix(np.concatenate([b.column(0).to_numpy().view(np.uint64) for b in held]))
            order = np.argsort(keys)
            keys = keys[order]
            values = np.stack([np.concatenate([b.column(i).to_numpy() for b in held])[order] for i in range(1, held[0].num_columns)])
            return _batch([(kind, s, "", pack(keys[low:high]), None, values[:, low:high].tobytes()) for s, low, high in _slices(keys, bits)])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= PACKED:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return table.mapInArrow(run, _ROWS)


def _answered(rows: DataFrame, columns: tuple[int, ...]) -> DataFrame:
    """The answers to the questions among packed rows, of partitions sorted by kind, slice and block: a slice of a table comes before its questions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, keys, values = None, [], None, None
        for batch in batches:
            out = []
            kinds, slices, blocks = (batch.column(i).to_pylist() for i in range(3))
            for i, (kind, s, block) in enumerate(zip(kinds, slices, blocks)):
                if (kind, s) != at:
                    at, parts, keys = (kind, s), [], None
                blob = batch.column(3)[i].as_py()
                if not block:
                    parts.append((unpack(blob), np.frombuffer(batch.column(5)[i].as_py(), np.float32).reshape(columns[kind], -1)))
                    continue
                if keys is None:
                    keys = np.concatenate([k for k, _ in parts] or [np.zeros(0, np.uint64)])
                    values = np.concatenate([v for _, v in parts] or [np.zeros((columns[kind], 0), np.float32)], 1)
                    order, parts = np.argsort(keys), []
                    keys, values = keys[order], values[:, order]
                wanted = unpack(blob)
                where = np.searchsorted(keys, wanted)
                found = where < len(keys)
                found[found] = keys[where[found]] == wanted[found]
                some = values[:, where[found]]
                out.append((kind, s, block, None, np.packbits(found).tobytes(), pa.compress(some.tobytes(), "zstd", asbytes=True) if some.size else b""))
            yield _batch(out)

    return rows.mapInArrow(run, _ROWS)


def _name(wanted: tuple[np.ndarray, ...]) -> str:
    out = hashlib.blake2b(digest_size=16)
    for keys in wanted:
        out.update(np.array([len(keys)]).tobytes() + keys.tobytes())
    return out.hexdigest()


@dataclass
class Answers:
    """Where the answers to the blocks of a scan are, for tasks that scan the same rows again."""

    folder: str
    bits: tuple[int, ...]
    columns: tuple[int, ...]

    def of(self, wanted: tuple[np.ndarray, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind of table the keys among ``wanted`` (ascending mixed ones) that it has, as they were, and their values, one column a row."""
        import pyarrow.parquet as pq
        from pyarrow import fs
        files, folder = fs.FileSystem.from_uri(self.folder)
        got, some = {}, files.get_file_info(fs.FileSelector(f"{folder}/block={_name(wanted)}", allow_not_found=True))
        for info in some:
            if info.base_name.endswith(".parquet"):
                with files.open_input_file(info.path) as f:
                    for r in pq.ParquetFile(f).read(["kind", "slice", "found", "values"]).to_pylist():
                        got[r["kind"], r["slice"]] = r["found"], r["values"]
        out = []
        for kind, (keys, bits, columns) in enumerate(zip(wanted, self.bits, self.columns)):
            known, values = [np.zeros(0, np.uint64)], [np.zeros((0, columns), np.float32)]
            for s, low, high in _slices(keys, bits):
                if (kind, s) not in got:
                    raise RuntimeError("a block of rows has no answers: the table scanned is not the one that the questions came from")
                found, blob = got[kind, s]
                found = np.unpackbits(np.frombuffer(found, np.uint8), count=high - low).astype(bool)
                if n := int(found.sum()):
                    known.append(keys[low:high][found])
                    values.append(np.frombuffer(pa.decompress(blob, 4 * n * columns, "zstd", asbytes=True), np.float32).reshape(columns, n).T)
            out.append((unmix(np.concatenate(known)), np.concatenate(values)))
        return out


def answers(rows: DataFrame, asked: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, ...]]], tables: list[DataFrame]) -> Answers:
    """Looks up, in each of ``tables`` (key bigint, then float columns; no key twice), the keys that each block of ``rows`` asks for.

    The second scan finds its answers if its tasks get the same rows in the same order, as they do of files. ``asked`` gives for the batches of a task the distinct mixed keys of each block, ascending, one array for each table.
    """
    spark = rows.sparkSession
    same_splits(spark)
    bits = tuple(((t.count() - 1) // SLICE).bit_length() if not t.isEmpty() else 0 for t in tables)
    columns = tuple(len(t.columns) - 1 for t in tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wanted in asked(batches):
            name = _name(wanted)
            yield _batch([(kind, s, name, pack(keys[low:high]), None, None) for kind, keys in enumerate(wanted)
                          for s, low, high in _slices(keys, bits[kind])])

    packed = rows.mapInArrow(run, _ROWS)
    for kind, table in enumerate(tables):
        packed = packed.unionByName(_packed(table, kind, bits[kind]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _answered(packed.repartition(n, "kind", "slice").sortWithinPartitions("kind", "slice", "block"), columns)
    out = Answers(scratch_path(spark, "answers"), bits, columns)
    found.select("kind", "slice", "block", "found", "values").repartition(n, "block").write.option("compression", "none").partitionBy(
        "block").parquet(out.folder)
    return out

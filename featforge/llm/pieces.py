"""Encoding into sentence pieces with the byte span that every piece stands for, and decoding.

Normalisation is done here: the longest prefix that the model's compiled character map knows is replaced at each place, white
space is treated as the model says, and every normalised byte remembers the byte of the text that it came from. The
library's merges then run on the normalised text, by a copy of the model that leaves its input as it is, and the pieces'
lengths lead through the alignment back to spans of the original bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: U+2581 stands for a space in pieces.
_SPACE = "▁".encode()
#: Bytes of text whose pieces leave a task in one batch.
CHUNK = 1 << 20
_UNKNOWN, _USER, _BYTE = 2, 4, 6
_loaded: dict[str, Pieces] = {}


def _number(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message, embedded messages as bytes."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _number(data, at)
            value = data[at:at + size]
            at += size
        yield tag >> 3, value


def _message(field: int, data: bytes) -> bytes:
    """A field that holds bytes."""
    out, size = bytearray([field << 3 | 2]), len(data)
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes(out) + bytes([size]) + data


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 prefixes whose leaves point at replacements.

    The trie is a run of 32-bit cells; a cell holds the byte that leads to it, whether a key ends there, and the distance
    to its children; the cell at a key's end holds the place of the replacement, which a zero byte ends.
    """

    def __init__(self, compiled: bytes, kept: tuple[bytes, ...] = ()):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self._cells = np.frombuffer(compiled[4:4 + size], "<u4").tolist()
        self._values = compiled[4 + size:]
        self._kept = sorted(kept, key=len, reverse=True)
        #: Which two bytes a key, or a kept symbol, may begin with.
        self._starts = np.zeros(1 << 16, bool)
        for first in range(256 if self._cells else 0):
            cell = self._step(self._child(0), first)
            if cell is None:
                continue
            for second in range(256):
                if self._ends(cell) or self._step(self._child(cell), second) is not None:
                    self._starts[first << 8 | second] = True
        for symbol in self._kept:
            self._starts[symbol[0] << 8:(symbol[0] + 1) << 8] = True
        self.empty = not self._starts.any()

    def _child(self, cell: int) -> int:
        value = self._cells[cell]
        return cell ^ ((value >> 10) << ((value & 512) >> 6))

    def _step(self, children: int, byte: int) -> int | None:
        cell = children ^ byte
        return cell if cell < len(self._cells) and self._cells[cell] & 0x800000FF == byte else None

    def _ends(self, cell: int) -> bool:
        return bool(self._cells[cell] >> 8 & 1)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix and what replaces it; a kept symbol goes before and stays as it is."""
        for symbol in self._kept:
            if data.startswith(symbol, at):
                return len(symbol), symbol
        if not self._cells:
            return None
        found, children = None, self._child(0)
        for end in range(at, len(data)):
            cell = self._step(children, data[end])
            if cell is None:
                break
            children = self._child(cell)
            if self._ends(cell):
                found = end + 1 - at, self._cells[children] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self._values[found[1]:self._values.index(b"\0", found[1])]

    def replacements(self, data: bytes) -> list[tuple[int, int, bytes]]:
        """(start, length, replacement) from left to right, of the parts that do not stay as they are."""
        codes = np.frombuffer(data, np.uint8).astype(np.uint16)
        pairs = codes << 8
        pairs[:-1] |= codes[1:]
        likely = np.flatnonzero(self._starts[pairs] & ((codes & 0xC0) != 0x80))
        out, done = [], 0
        for at in likely.tolist():
            if at >= done and (found := self.longest(data, at)):
                out.append((at, *found))
                done = at + found[0]
        return out


class Pieces:
    """A model file: normalisation with alignment, pieces of normalised text, and the library's decoder."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        with open(path, "rb") as f:
            model = f.read()
        parts = list(_fields(model))
        spec = dict(_fields(next((v for k, v in parts if k == 3), b"")))
        trainer = dict(_fields(next((v for k, v in parts if k == 2), b"")))
        entries = [dict(_fields(v)) for k, v in parts if k == 1]
        names, kinds = [e[1] for e in entries], [e.get(3, 1) for e in entries]
        self._dummy, self._squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self._space = _SPACE if spec.get(5, 1) else b" "
        self._suffix = bool(trainer.get(24, 0))
        self.map = CharacterMap(spec.get(2, b""), tuple(n for n, k in zip(names, kinds) if k == _USER))
        whole = SentencePieceProcessor(model_proto=model)
        self._whole, self.end = whole, whole.eos_id()
        # The same pieces, but text is left as it is: no character map (2) and no white space rules (3, 4, 5).
        plain = _message(1, b"identity") + b"\x18\0\x20\0\x28\0"
        same = b"".join(_message(k, v) for k, v in parts if k in (1, 2))
        self._plain = SentencePieceProcessor(model_proto=same + _message(3, plain))
        self._length = np.array([len(n) for n in names], np.int32)
        self._byte = np.array([int(n[3:5], 16) if k == _BYTE else -1 for n, k in zip(names, kinds)], np.int32)
        self._unknown = np.array([k == _UNKNOWN for k in kinds])

    @staticmethod
    def load(path: str) -> Pieces:
        """One per worker process and file."""
        if path not in _loaded:
            _loaded[path] = Pieces(path)
        return _loaded[path]

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them, and for their end, the byte of ``data`` where its source begins."""
        if not data:
            return b"", np.zeros(1, np.int32)
        kind = np.int32 if len(data) < 1 << 30 else np.int64
        codes = np.frombuffer(data, np.uint8)
        # Every byte belongs to a chunk: a character that stays, or a replacement.
        lead = (codes & 0xC0) != 0x80
        source = np.maximum.accumulate(np.where(lead, np.arange(len(codes), dtype=kind), 0))
        out, origin = codes, source
        if not self.map.empty and (changed := self.map.replacements(data)):
            bytes_, origins, done = [], [], 0
            for at, size, new in changed:
                bytes_ += [data[done:at], new]
                origins += [source[done:at], np.full(len(new), at, kind)]
                done = at + size
            out = np.frombuffer(b"".join([*bytes_, data[done:]]), np.uint8)
            origin = np.concatenate([*origins, source[done:]])
        if self._squeeze and len(out):
            space = out == 0x20
            first = np.ones(len(out), bool)
            first[1:] = origin[1:] != origin[:-1]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(out)), 0))
            others = np.concatenate(([0], np.cumsum(~space)))
            leading = others[:-1] == others[begin]
            after = np.where(begin > 0, space[begin - 1], True)
            keep = ~(space & leading & after)
            out, origin = out[keep], origin[keep]
            if not len(out):
                return b"", np.full(1, len(data), kind)
        end = len(data)
        space = out == 0x20
        width = len(self._space)
        if width > 1 and space.any():
            times = np.where(space, width, 1)
            at = np.flatnonzero(np.repeat(space, times))
            out, origin = np.repeat(out, times), np.repeat(origin, times)
            out[at] = np.tile(np.frombuffer(self._space, np.uint8), len(at) // width)
        norm = out.tobytes()
        head = int(origin[0]) if len(origin) else 0
        if self._dummy and not self._suffix:
            norm, origin = self._space + norm, np.concatenate((np.full(width, head, kind), origin))
        if self._squeeze:
            while norm.endswith(self._space):
                end = int(origin[len(norm) - width])
                norm, origin = norm[:-width], origin[:-width]
        if self._dummy and self._suffix:
            norm, origin = norm + self._space, np.concatenate((origin, np.full(width, end, kind)))
        return norm, np.append(origin, kind(end))

    def _widths(self, found: list[list[int]], normal: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts one after another, the normalised bytes that each covers, and where each text begins."""
        edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(edges[-1]))
        sizes, byte = self._length[ids], self._byte[ids]
        first = np.flatnonzero((byte >= 0) & ((byte & 0xC0) != 0x80))
        if len(first):  # the last byte of a character stands for it
            width = np.select([byte[first] >= 0xF0, byte[first] >= 0xE0, byte[first] >= 0xC0], [4, 3, 2], 1)
            sizes[byte >= 0] = 0
            sizes[first + width - 1] = width
        for i in np.unique(np.searchsorted(edges, np.flatnonzero(self._unknown[ids]), "right") - 1).tolist():
            # A protocol message tells how much of the text an unknown piece covers.
            told = self._plain.encode(normal[i], return_type="proto").pieces
            sizes[edges[i]:edges[i + 1]] = [p.end - p.begin for p in told]
        return ids, sizes, edges

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text, the end id last; starts and ends are bytes of the text's UTF-8 form."""
        data = [t.encode() for t in texts]
        normal = [self.normalise(d) for d in data]
        plain = [n.decode() for n, _ in normal]
        ids, sizes, edges = self._widths(self._plain.encode(plain, num_threads=1), plain)
        out = []
        for d, (_, origin), low, high in zip(data, normal, edges[:-1].tolist(), edges[1:].tolist()):
            starts = np.full(high - low + 1, len(d), np.int32)
            ends = np.full(high - low + 1, len(d), np.int32)
            upto = np.cumsum(sizes[low:high])
            ends[:-1] = origin[upto]
            if high > low:
                starts[0], starts[1:-1] = origin[0], ends[:-2]
            out.append((np.append(ids[low:high], np.int32(self.end)), starts, ends))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self._whole.decode(ids, num_threads=1)


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for i, t in enumerate(texts):
        if i > low and size + len(t) > CHUNK:
            yield low, i
            low, size = i, 0
        size += len(t)
    if low < len(texts):
        yield low, len(texts)


def encode_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: key, ids, starts, ends of its pieces, as the library gives them, with the end id.

    Piece i stands for the bytes ``starts[i]`` up to ``ends[i]`` of the text in UTF-8; a character that falls back to bytes is
    covered by the last of its pieces, and the end id stands for nothing at the end. Null texts count as empty and give the
    end id alone; repeated rows are encoded alike; other columns are not read. ``path`` must be readable by the executors.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for low, high in _runs(texts):
                found = model.encode(texts[low:high])
                edges = pa.array(np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([f[k] for f in found]))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *lists], ["key", "ids", "starts", "ends"])

    out = rows.mapInArrow(run, f"key {kind}, ids array<int>, starts array<int>, ends array<int>")
    return out.withColumnRenamed("key", key)


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with ``name``, the library's text of ``ids``; null ids give null. A column ``name`` is replaced."""
    from pyspark.sql.types import StringType, StructField, StructType
    rows = encoded.drop(name)
    at = rows.columns.index(ids)
    schema = StructType([*rows.schema.fields, StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.load(path)
        for batch in batches:
            lists = batch.column(at)
            sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            total = np.cumsum(sizes)
            low = 0
            while low < len(lists):
                done = total[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(total, done + CHUNK, "right")))
                some = lists.slice(low, high - low)
                texts = model.decode([v or [] for v in some.to_pylist()])
                column = pa.array([t if ok else None for t, ok in zip(texts, some.is_valid().to_pylist())], pa.string())
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, name])
                low = high

    return rows.mapInArrow(run, schema)

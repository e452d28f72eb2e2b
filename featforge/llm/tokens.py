"""Token ids of whole texts by the ``tokenizers`` library, encoding every distinct word once.

The tokenizers meant here split at white space before merging, so the ids of a text are the ids of its white-space
separated pieces one after another; a mark after a letter is a piece of its own too. Each worker process keeps a
bounded dictionary from piece to ids, and a run of texts asks it once for each distinct piece.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from featforge.llm import text as X

#: Distinct pieces kept by a worker; longer pieces than ``LONGEST`` bytes are encoded each time.
MAX_PIECES = 500_000
LONGEST = 64

#: Letters that no normalisation changes: each such word is one word to the tokenizer.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_MARKS = np.isin(np.arange(256), list(b".,;:!?"))
_ASCII_LETTERS = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_JOINED = 2000
_loaded: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tokenizer = t = Tokenizer.from_file(path)
        self._lower = b"Lowercase" in t.normalizer.__getstate__() if t.normalizer else False
        suffix = getattr(t.model, "end_of_word_suffix", None)
        self._ends = None
        if suffix:  # then the ids of several words can be told apart
            self._ends = np.zeros(t.get_vocab_size(), bool)
            self._ends[[i for token, i in t.get_vocab().items() if token.endswith(suffix)]] = True
        self._clear()

    @staticmethod
    def load(path: str) -> Encoder:
        """One encoder per worker process and file."""
        if path not in _loaded:
            _loaded[path] = Encoder(path)
        return _loaded[path]

    def _clear(self) -> None:
        self._code: dict[bytes, int] = {}
        self._flat, self._from = array("I"), array("q", [0])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, pieces: list[bytes]) -> None:
        plain = [p for p in pieces if _LETTERS.fullmatch(p)] if self._ends is not None else []
        for at in range(0, len(plain), _JOINED):
            some = plain[at:at + _JOINED]
            ids = np.array(self._encode([b" ".join(some).decode()])[0], np.uint32)
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(some):
                break  # not this kind of tokenizer: one by one below
            base = len(self._flat)
            self._flat.frombytes(ids.tobytes())
            for p, end in zip(some, (ends + base).tolist()):
                self._code[p] = len(self._from) - 1
                self._from.append(end)
        rest = [p for p in pieces if p not in self._code]
        for p, ids in zip(rest, self._encode([p.decode() for p in rest])):
            self._code[p] = len(self._from) - 1
            self._flat.extend(ids)
            self._from.append(len(self._flat))

    def ids(self, t: X.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and where each text begins among them."""
        lead = np.flatnonzero(np.bincount(t.data, minlength=256)[0xC0:]) + 0xC0
        lower = self._lower and set(lead.tolist()) <= {0xC2, 0xC3} and not np.any(
            (t.data[:-1] == 0x3C) & (t.data[1:] == 0x7C))
        start, end, doc = t.start, t.end, t.doc
        cut = np.flatnonzero(_MARKS[t.data[end - 1]] & (end - start > 1))
        cut = cut[_ASCII_LETTERS[t.data[end[cut] - 2]]]
        order = np.argsort(np.concatenate((start, end[cut] - 1)), kind="stable")
        ends = end.copy()
        ends[cut] -= 1
        start = np.concatenate((start, end[cut] - 1))[order]
        end = np.concatenate((ends, end[cut]))[order]
        doc = np.concatenate((doc, doc[cut]))[order]
        keys = t.lower_hashes(start, end) if lower else t.hashes(start, end, whole=True)
        _, first, code_of = np.unique(keys, return_index=True, return_inverse=True)
        if len(self._code) > MAX_PIECES:
            self._clear()
        raw = t.data.tobytes().lower() if lower else t.data.tobytes()
        pieces = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        new = [p for p in pieces if p not in self._code]
        self._learn(new)
        codes = np.fromiter(map(self._code.__getitem__, pieces), np.int64, len(pieces))[code_of]
        flat, at = np.frombuffer(self._flat, np.uint32), np.frombuffer(self._from, np.int64)
        length = at[codes + 1] - at[codes]
        total = np.concatenate(([0], np.cumsum(length)))
        ids = flat[np.repeat(at[codes] - total[:-1], length) + np.arange(total[-1])]
        del flat, at
        for p in new:
            if len(p) > LONGEST:
                del self._code[p]
        return ids, total[np.searchsorted(doc, np.arange(t.n + 1))]


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of whole texts: the row of the first, all their ids, and where each text begins; null is empty."""
    encoder = Encoder.load(path)
    for t in X.chunks(column, X.SPACED):
        yield t.first, *encoder.ids(t)

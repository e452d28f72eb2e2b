"""Quality rules by repetition coverage: how many characters lie inside duplicated n-grams and duplicated lines."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from featforge.llm import text as X

#: Largest share of word characters inside n-grams that occur twice or more, by the number of words.
LIMITS = {5: 0.20, 6: 0.20, 7: 0.18, 8: 0.16, 9: 0.14, 10: 0.12}
MAX_LINE_CHARS = 0.30
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "dup_line_chars"]


def _lines(t: X.Texts, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: lines equal to an earlier one, characters of lines with a word, characters in duplicated lines."""
    breaks = np.flatnonzero(t.data == 10)
    starts = np.sort(np.concatenate((t.edges[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, t.edges[1:])))
    kept = np.searchsorted(t.start, ends) > np.searchsorted(t.start, starts)
    starts, ends = starts[kept], ends[kept]
    doc = np.searchsorted(t.edges, starts, "right") - 1
    keys = X.in_text(t.hashes(starts, ends, whole=True), doc)
    chars = points[ends] - points[starts]
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    total = lambda weight: np.bincount(doc, weight, t.n).astype(np.int64)
    return total(again), total(chars), total(chars * X.repeated(keys))


def measure(column: pa.Array, lengths: list[int]) -> dict[str, np.ndarray]:
    """Counts per text; ``dup_chars_N`` are characters of words inside N-word runs that occur twice or more."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in [*_COUNTS, *[f"dup_chars_{n}" for n in lengths]]}
    for t in X.chunks(column, X.SPACED):
        points, words = t.points(), t.word_hashes()
        chars = points[t.end] - points[t.start]
        symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[t.data])))
        again, line_chars, dup_line_chars = _lines(t, points)
        per_text = lambda weight: np.bincount(t.doc, weight, t.n).astype(np.int64)  # noqa: E731, B023
        found = {"n_words": np.diff(t.bounds), "word_chars": per_text(chars), "n_symbols": t.per_text(symbols),
                 "n_dup_lines": again, "line_chars": line_chars, "dup_line_chars": dup_line_chars}
        repeats = None
        for n in sorted({5, *lengths}):
            keys, at = X.ngrams(words, t.doc, n)
            if repeats is not None:  # a longer run occurs again only where the shorter one does
                keys, at = keys[repeats[at]], at[repeats[at]]
            at = at[X.repeated(X.in_text(keys, t.doc[at]))]
            repeats = np.zeros(len(words), bool)
            repeats[at] = True
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            covered = np.cumsum(cover)[:-1] > 0
            if n == 5:
                found["n_repeat_words"] = per_text(covered)
            if n in lengths:
                found[f"dup_chars_{n}"] = per_text(chars * covered)
        for k, v in found.items():
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def quality(docs: DataFrame, text: str = "text", key: str = "doc_id", limits: Mapping[int, float] = LIMITS,
            max_line_chars: float = MAX_LINE_CHARS) -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``.

    ``base_failed``: under 10 words, or over a fifth of the words inside repeated 5-word runs. ``kept`` also asks that
    duplicated n-grams of each length in ``limits`` and duplicated lines cover no more than their share of characters.
    A null or empty text has no words and fails. Repeated rows are judged one by one; the key may be null; other columns
    are not read. A text of any length is measured whole; the memory of a task follows the longest text.
    """
    names = sorted(limits)
    counts = [*_COUNTS, *[f"dup_chars_{n}" for n in names]]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(1), names)
            bad = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
            good = ~bad & (m["dup_line_chars"] <= max_line_chars * m["line_chars"])
            for n in names:
                good &= m[f"dup_chars_{n}"] <= limits[n] * m["word_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m[c]) for c in counts], pa.array(bad),
                                              pa.array(good)], [key, *counts, "base_failed", "kept"])

    schema = ", ".join([f"`{key}` {kind}", *[f"{c} bigint" for c in counts], "base_failed boolean", "kept boolean"])
    return docs.select(key, text).mapInArrow(run, schema)

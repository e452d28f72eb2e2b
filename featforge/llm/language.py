"""Language of each word by a linear-chain conditional random field, and of each text by its words' marginals.

Features of a word: itself, its affixes, its letter n-grams and the language lexicons it is in. They are hashed into
weights for each language; transitions between neighbouring words are learned too, so a text may switch language. Training
maximises the conditional likelihood of chains by forward-backward; prediction takes the marginals.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featforge.llm.text import release

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_MAX_CACHED = 200_000
#: Letters of the longest word; writing without spaces is read as words of so many letters.
LONGEST = 40


@dataclass
class Settings:
    """Bounds of the fit. ``rows`` labelled rows of each language give ``chains`` runs of ``length`` words each, spread evenly
    over the whole text."""

    rows: int = 200
    chains: int = 8
    length: int = 48
    buckets: int = 1 << 16
    lexicon: int = 300
    rounds: int = 40
    rate: float = 0.3
    decay: float = 1e-4


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; runs of over ``LONGEST`` letters as several words, so that all their letters are read."""
    out = []
    for run in _WORD.findall((text or "").lower()):
        # The pattern takes signs such as a raised 2 for parts of words.
        parts = [run] if run.isalpha() else ["".join(g) for letters, g in groupby(run, str.isalpha) if letters]
        for w in parts:
            out += [w] if len(w) <= LONGEST else [w[i:i + LONGEST] for i in range(0, len(w), LONGEST)]
    return out


def features(word: str, buckets: int) -> list[int]:
    n = len(word)
    names = [f"w{word}", *[f"p{word[:k]}" for k in range(1, min(4, n) + 1)], *[f"s{word[-k:]}" for k in range(1, min(4, n) + 1)]]
    framed = f"^{word}$"
    names += [f"g{framed[i:i + k]}" for k in (2, 3) for i in range(len(framed) - k + 1)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % buckets for x in names]


def _marginals(scores: np.ndarray, mask: np.ndarray, step: np.ndarray, first: np.ndarray,
               weight: np.ndarray | None = None):
    """Posterior of each label at each place, for chains padded at the end; with a ``weight`` for each
    chain, also the expected transitions, weighted and summed.

    scores: chains x places x labels; step: label x label and first: label log weights.
    """
    n, length, labels = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    move, begin = np.exp(step - step.max()), np.exp(first - first.max())
    ahead, back = np.empty_like(emit), np.empty_like(emit)
    now = begin * emit[:, 0]
    ahead[:, 0] = now / now.sum(1, keepdims=True)
    for t in range(1, length):
        now = (ahead[:, t - 1] @ move) * emit[:, t]
        ahead[:, t] = now / now.sum(1, keepdims=True)
    back[:, -1] = 1
    for t in range(length - 2, -1, -1):
        now = (emit[:, t + 1] * back[:, t + 1]) @ move.T
        back[:, t] = np.where(mask[:, t + 1, None], now / now.sum(1, keepdims=True), 1)
    both = ahead * back
    both /= both.sum(2, keepdims=True)
    if weight is None:
        return both
    total = np.zeros((labels, labels))
    for t in range(1, length):
        joint = ahead[:, t - 1, :, None] * move[None] * (emit[:, t] * back[:, t])[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        total += (joint * (weight * mask[:, t])[:, None, None]).sum(0)
    return both, total


class Crf:
    def __init__(self, labels: list[str], weights: np.ndarray, step: np.ndarray, first: np.ndarray, lexicon: dict[str, list[int]],
                 settings: Settings):
        self.labels, self.weights, self.step, self.first = labels, weights, step, first
        self.lexicon, self.settings = lexicon, settings
        self._row: dict[str, int] = {}
        self._rows: list[np.ndarray] = []

    def __getstate__(self):
        return self.__dict__ | {"_row": {}, "_rows": []}

    def _indices(self, word: str) -> list[int]:
        s = self.settings
        return features(word, s.buckets) + [s.buckets + k for k in self.lexicon.get(word, ())]

    @staticmethod
    def fit(chains: list[tuple[str, list[str]]], settings: Settings) -> Crf:
        """From (language, words) chains; full-batch steps with adaptive rates, so the result depends on the set of chains only."""
        chains = sorted(c for c in chains if c[1])
        labels = sorted({c[0] for c in chains})
        often = {k: Counter() for k in labels}
        for lang, words in chains:
            often[lang].update(words)
        lexicon: dict[str, list[int]] = {}
        for k, lang in enumerate(labels):
            for word, n in sorted(often[lang].items(), key=lambda x: (-x[1], x[0]))[:settings.lexicon]:
                if n > 2:
                    lexicon.setdefault(word, []).append(k)
        size = len(labels)
        model = Crf(labels, np.zeros((settings.buckets + size, size)), np.zeros((size, size)), np.zeros(size), lexicon, settings)
        if not chains:
            return model
        vocabulary = sorted({w for _, words in chains for w in words})
        code = {w: i for i, w in enumerate(vocabulary)}
        lists = [model._indices(w) for w in vocabulary]
        of_word, of_feature = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
        begins = np.searchsorted(of_word, np.arange(len(lists)))
        length = max(len(words) for _, words in chains)
        at, mask = np.zeros((len(chains), length), np.int64), np.zeros((len(chains), length), bool)
        for i, (_, words) in enumerate(chains):
            at[i, :len(words)] = [code[w] for w in words]
            mask[i, :len(words)] = True
        truth = np.array([labels.index(lang) for lang, _ in chains])
        # Every language counts the same, whatever the length of its texts.
        weight = (1 / np.bincount(truth, mask.sum(1), size))[truth] * mask.sum() / size
        seen = np.zeros((size, size))
        np.add.at(seen, (truth, truth), (mask.sum(1) - 1) * weight)
        flat, per = at[mask], np.repeat(weight, mask.sum(1))
        right = np.repeat(truth, mask.sum(1))
        target = np.zeros((len(flat), size))
        target[np.arange(len(flat)), right] = 1
        momenta = [np.full_like(x, 1e-8) for x in (model.weights, model.step, model.first)]
        total = per.sum()
        for _ in range(settings.rounds):
            emission = np.add.reduceat(model.weights[of_feature], begins)
            both, moved = _marginals(emission[at], mask, model.step, model.first, weight)
            gap = (target - both[mask]) * per[:, None]
            by_word = np.stack([np.bincount(flat, gap[:, k], len(vocabulary)) for k in range(size)], 1)
            up = np.stack([np.bincount(of_feature, by_word[of_word, k], len(model.weights)) for k in range(size)], 1)
            begin = (np.eye(size)[truth] - both[:, 0]) * weight[:, None]
            grads = [up, seen - moved, begin.sum(0)]
            for x, g, m in zip((model.weights, model.step, model.first), grads, momenta):
                g = g / total - settings.decay * x
                m += g * g
                x += settings.rate * g / np.sqrt(m)
        model.weights = model.weights.astype(np.float32)
        return model

    def _emission(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each label; a bounded number of words is remembered."""
        if len(self._row) > _MAX_CACHED:
            self._row, self._rows = {}, []
        new = list({w for w in words if w not in self._row})
        if new:
            lists = [self._indices(w) for w in new]
            begins = np.cumsum([0, *[len(x) for x in lists[:-1]]])
            base = len(self._row)
            self._rows.append(np.add.reduceat(self.weights[np.concatenate(lists)], begins))
            self._row.update({w: base + i for i, w in enumerate(new)})
            self._rows = [np.concatenate(self._rows)]
        return self._rows[0][np.fromiter(map(self._row.__getitem__, words), np.int64, len(words))]

    def label_words(self, words: list[str]) -> list[str]:
        """The likeliest language of each word of one text."""
        marginal = self._posterior(words, np.array([len(words)]))
        return [self.labels[k] for k in marginal.argmax(1)]

    def _posterior(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Marginals of all words; each text is cut into chains of 64 words."""
        size, labels = 64, len(self.labels)
        emission = self._emission(words)
        chains = -(-counts // size)
        starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
        begin = np.repeat(starts, chains) + size * (np.arange(chains.sum()) - np.repeat(np.cumsum(chains) - chains, chains))
        end = np.minimum(begin + size, np.repeat(starts + counts, chains))
        out = np.empty((len(words), labels), np.float32)
        for low in range(0, len(begin), 4096):
            b, e = begin[low:low + 4096], end[low:low + 4096]
            places = b[:, None] + np.arange(int((e - b).max()))
            mask = places < e[:, None]
            scores = np.where(mask[..., None], emission[np.minimum(places, len(words) - 1)], 0)
            out[places[mask]] = _marginals(scores, mask, self.step.astype(np.float32), self.first.astype(np.float32))[mask]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the mean marginal of its words by their letters."""
        found = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in found], np.int64)
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        words = [w for ws in found for w in ws]
        if not words or not self.labels:
            return names, score
        letters = np.fromiter(map(len, words), np.float64, len(words))
        doc = np.repeat(np.arange(len(texts)), counts)
        marginal = self._posterior(words, counts)
        mean = np.stack([np.bincount(doc, marginal[:, k] * letters, len(texts)) for k in range(len(self.labels))], 1)
        mean /= np.maximum(np.bincount(doc, letters, len(texts)), 1)[:, None]
        best = mean.argmax(1)
        for i in np.flatnonzero(counts).tolist():
            names[i], score[i] = self.labels[best[i]], min(1.0, float(mean[i, best[i]]))
        return names, score


def fit_language(docs: DataFrame, train: Column | None = None, settings: Settings | None = None) -> Crf:
    """From rows with ``text`` and non-null ``lang`` where ``train`` holds.

    At most ``settings.rows`` rows of each language are drawn by a hash, and what reaches the driver is their chains, a
    bounded number of words. Without labelled rows the model knows no language.
    """
    settings = settings or Settings()
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if train is not None:
        rows = rows.filter(F.coalesce(train, F.lit(False)))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one number for each language that the model has
    draw = F.xxhash64("doc_id", "text", F.lit(11))
    # A few more than wanted are taken by their hash as they are read, so no language is gathered whole.
    shares = [F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, (1.5 * settings.rows + 30) / n)]
    share = F.element_at(F.create_map(*shares), F.col("lang")) if shares else F.lit(0.0)
    drawn = rows.select("lang", "text", draw.alias("_draw")).filter(F.pmod("_draw", F.lit(1 << 30)) / float(1 << 30) < share)
    drawn = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_draw"))).filter(
        F.col("_rank") <= settings.rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, runs = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                last = max(0, len(words) - settings.length)
                for begin in sorted({last * k // max(1, settings.chains - 1) for k in range(settings.chains)}):
                    langs.append(lang)
                    runs.append(words[begin:begin + settings.length])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(runs, pa.list_(pa.string()))], ["lang", "words"])

    chains = drawn.select("lang", "text").mapInArrow(cut, "lang string, words array<string>").toArrow()
    return Crf.fit(list(zip(chains["lang"].to_pylist(), chains["words"].to_pylist())), settings)


def predict_language(docs: DataFrame, model: Crf, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``; ``und`` and 0 for a null text or one without letters.

    Whole texts are read, some at a time; other columns pass through and existing ones of these names are replaced.
    """
    names = [f"{prefix}lang_pred", f"{prefix}score"]
    kept = [f for f in docs.schema.fields if f.name not in names]
    at = [f.name for f in kept].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            sizes = np.cumsum([len(x or "") for x in batch.column(at).to_pylist()])
            while low < batch.num_rows:  # about a million letters at a time
                before = sizes[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(sizes, before + 1_000_000, "right")))
                part = batch.slice(low, high - low)
                lang, score = model.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score)],
                                                 [*[f.name for f in kept], *names])
                low = high
            release()

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    schema = StructType([*kept, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return docs.select(*[f.name for f in kept]).mapInArrow(run, schema)


def held_out(key: str = "doc_id", of: int = 4, rest: int = 2) -> Column:
    """crc32 of the key as text, by its remainder; a null key is not held out and not learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of == rest

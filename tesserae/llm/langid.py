"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the
sum, over all ways to cut it into pieces, of the product of their probabilities, which a forward pass over the word's
bytes gives. A text's is the product over its words. Words are remembered up to a bound.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices
from .word_ids import word_ids

_WORD = re.compile(r"[^\W\d_]+")
_END = "</w>"
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower()) if text else []


_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Pieces:
    """A vocabulary as an open table of hashes, which many byte strings are looked up in at once.

    ``ids``: by slot, the piece's id inside a word and at its end (-1: none). Endings of pieces have slots too, so that a
    search backwards from a byte stops as soon as no piece can follow.
    """

    size: int
    longest: int
    keys: np.ndarray
    ids: np.ndarray

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; -1 where it has none."""
        mask, bits = len(self.keys) - 1, len(self.keys).bit_length() - 1
        out, todo = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        at = (hashes * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)
        while len(todo):
            key = self.keys[at]
            hit = key == hashes[todo]
            out[todo[hit]] = at[hit]
            further = ~hit & (key != 0)
            todo, at = todo[further], (at[further] + 1) & mask
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    # byte-level vocabularies write printable bytes as themselves, the others from code point 256 on
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [x for x in range(256) if x not in set(shown)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
    named: dict[bytes, list[int]] = {}
    for piece, number in vocabulary.items():
        last = piece.endswith(_END) and piece != _END
        data = bytes(byte[x] for x in (piece.removesuffix(_END) if last else piece))
        named.setdefault(data, [-1, -1])[last] = number
    table: dict[int, list[int]] = {}
    for data, ids in named.items():
        value, weight = 0, 1
        for k in range(len(data) - 1, -1, -1):
            value, weight = (value + (data[k] + 1) * weight) % (1 << 64), weight * _BASE % (1 << 64)
            if k:
                table.setdefault(value, [-1, -1])
        if table.get(value, ids) not in (ids, [-1, -1]):
            raise ValueError("two pieces share a hash")
        table[value] = ids
    bits = (2 * len(table)).bit_length()
    keys, found = np.zeros(1 << bits, np.uint64), np.full((1 << bits, 2), -1, np.int32)
    for value, ids in table.items():
        at = (value * int(_SPREAD) % (1 << 64)) >> (64 - bits)
        while keys[at]:
            at = (at + 1) % (1 << bits)
        keys[at], found[at] = value, ids
    return Pieces(1 + max(vocabulary.values()), max(map(len, named)), keys, found)


def forward(words: list[bytes], table: Pieces, chance: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """Log probability of each word (none is empty) in each language; ``chance``: of pieces by languages.

    Words of any length: chunks hold about ``most`` bytes, or one word.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes[order])
    out, begin = np.empty((len(words), chance.shape[1])), 0
    while begin < len(words):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most)))
        out[order[begin:end]] = _forward([words[i] for i in order[begin:end].tolist()], sizes[order[begin:end]], table, chance)
        begin = end
    return out


def _forward(words: list[bytes], sizes: np.ndarray, table: Pieces, chance: np.ndarray, rescale: int = 24) -> np.ndarray:
    """Words by length, the longest first. Places in words are numbered by their distance from the beginning, then by word,
    so that those of a distance, a level, are neighbours: each level is summed at once from the levels before it."""
    n, longest = len(words), int(sizes[0])
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # words that reach a level
    base = np.concatenate(([0], np.cumsum(live)))
    level = np.repeat(np.arange(longest), live)
    word = np.arange(base[-1]) - base[level]
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    data = (np.frombuffer(b"".join(words), np.uint8)[begins[word] + level]).astype(np.uint64) + np.uint64(1)
    last = (level + 1 == sizes[word]).astype(np.int8)
    # backwards from each place, as long as a piece may still end there
    alive, value, weight, found = np.arange(base[-1]), np.zeros(base[-1], np.uint64), 1, []
    for length in range(1, min(table.longest, longest) + 1):
        alive_here = level[alive] + 1 >= length
        alive, value = alive[alive_here], value[alive_here]
        value = value + data[base[level[alive] + 1 - length] + word[alive]] * np.uint64(weight)
        weight = weight * _BASE % (1 << 64)
        slot = table.slots(value)
        hit = slot >= 0
        alive, value, slot = alive[hit], value[hit], slot[hit]
        piece = table.ids[slot, last[alive]]
        whole = piece >= 0
        found.append((length, alive[whole], piece[whole]))
    # edges, dealt to their places
    counts = np.zeros(base[-1] + 1, np.int64)
    for _, place, _ in found:
        counts[place + 1] += 1
    first = np.cumsum(counts)
    source, by, free = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64), first[:-1].copy()
    for length, place, piece in found:
        at = free[place]
        free[place] += 1
        before = level[place] - length
        source[at], by[at] = np.where(before < 0, 0, n + base[before]) + word[place], piece
    sums = np.zeros((n + base[-1], chance.shape[1]))
    sums[:n] = 1
    scale = np.zeros((n, chance.shape[1]))
    for k in range(longest):
        a, b = base[k], base[k + 1]
        some = a + np.flatnonzero(first[a + 1 : b + 1] > first[a:b])
        if len(some):
            edges = slice(first[a], first[b])
            sums[n + some] = np.add.reduceat(sums[source[edges]] * chance[by[edges]], first[some] - first[a], axis=0)
        if k % rescale == rescale - 1 and k + 1 < longest:
            count = live[k + 1]
            recent = [sums[n + base[i] : n + base[i] + count] for i in range(max(0, k + 1 - table.longest), k + 1)]
            top = np.maximum.reduce(recent)
            top[top == 0] = 1
            for part in recent:
                part /= top
            scale[:count] += np.log(top)
    with np.errstate(divide="ignore"):
        return np.log(sums[n + base[sizes - 1] + np.arange(n)]) + scale


class _Numbers(dict):
    """Numbers tokens as they come; ``new`` has those since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        self.new.append(token)
        return number


class WordScores:
    """Log probabilities of the ``limit`` tokens between white space seen last, and of as many before.

    A token's is the sum over its runs of letters.
    """

    def __init__(self, path: str, chance: np.ndarray, limit: int = 450_000):
        self.table, self.chance, self.limit = pieces(path), chance, limit
        self.tokens = self.older = _Numbers()
        self.rows = self.older_rows = np.zeros((4096, chance.shape[1]), np.float32)

    def _score(self, new: list[str]) -> None:
        """Rows of the tokens numbered last."""
        begin = len(self.tokens) - len(new)
        while len(self.rows) < len(self.tokens):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        before = np.fromiter((self.older.get(x, -1) for x in new), np.int64, len(new)) if self.older is not self.tokens else np.full(len(new), -1)
        known, fresh = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
        self.rows[begin + known] = self.older_rows[before[known]]
        words, owner = [], []
        for i in fresh.tolist():
            token = new[i]
            if token.isalpha():
                words.append(token.encode())
                owner.append(i)
            else:
                found = _WORD.findall(token)
                words += map(str.encode, found)
                owner += [i] * len(found)
        if words:
            owner, scores = np.array(owner), forward(words, self.table, self.chance)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            self.rows[begin + owner[first]] = np.add.reduceat(scores, first, axis=0)

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """Sum over the words of each text, by language."""
        tokens, ends = [], []
        for text in texts:
            tokens += text.lower().split() if text else []
            ends.append(len(tokens))
        at, out, begin = np.array(list(map(self.tokens.__getitem__, tokens)), np.int64), np.zeros((len(texts), self.chance.shape[1])), 0
        if self.tokens.new:
            self._score(self.tokens.new)
            self.tokens.new = []
        for i, end in enumerate(ends):
            out[i] = self.rows[at[begin:end]].sum(axis=0, dtype=np.float64)
            begin = end
        if len(self.tokens) > self.limit:
            self.older, self.older_rows = self.tokens, self.rows
            self.tokens, self.rows = _Numbers(), np.zeros_like(self.rows[:4096])
        return out


@dataclass(frozen=True)
class LanguageModel:
    """``chance``: probability of each piece (rows) in each of ``languages`` (columns).

    ``saved``: share of the code length under equally likely pieces that each language saves on its labelled texts.
    """

    tokenizer: str
    languages: list[str]
    chance: np.ndarray
    saved: np.ndarray | None = None

    def predict(self, spark: SparkSession, text: str | F.Column = "text", fit: bool = False) -> F.Column:
        """A struct of ``lang`` and ``score`` (its posterior under equal priors) for a text column.

        A null text, one without a letter, and any text under a model without languages are ``und`` with score 0.
        With ``fit`` also what the language saves on the text, in units of what it saves on its labelled texts: about 1
        for its own, about 0 or less for texts of languages that nothing taught, however long.
        """
        chance = np.column_stack((self.chance, np.full(len(self.chance), 1 / len(self.chance)))) if fit else self.chance
        shared = spark.sparkContext.broadcast((self.tokenizer, self.languages, chance, self.saved))
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), *[("fit", pa.float64())] * fit])

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            path, languages, chance, saved = shared.value
            word_ids.cache_clear()  # what fitting remembered is not needed any more
            scores = WordScores(path, chance)
            for column in columns:
                texts, out = column.to_pylist(), []
                for a, b in text_slices(texts, 1 << 20):
                    total = scores.totals(texts[a:b]) if languages else np.zeros((b - a, 1))
                    if fit and languages:
                        total, even = total[:, :-1], np.minimum(total[:, -1], -1e-9)
                        fits = (1 - total.max(axis=1) / even) / saved[total.argmax(axis=1)]
                    else:
                        fits = np.zeros(b - a)
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    for text, k, x, y in zip(texts[a:b], best.tolist(), share.tolist(), fits.tolist(), strict=True):
                        known = bool(languages and text) and any(map(str.isalpha, text))
                        row = {"lang": languages[k], "score": x, "fit": y} if known else {"lang": UNKNOWN, "score": 0.0, "fit": 0.0}
                        out.append(row if fit else {"lang": row["lang"], "score": row["score"]})
                yield pa.array(out, kind)

        return F.arrow_udf(run, "lang string, score double" + ", fit double" * fit)(text)


@dataclass(frozen=True)
class LanguageId:
    """``smoothing``: added to the count of every piece of every language."""

    tokenizer: str
    smoothing: float = 0.5

    def fit(self, labelled: DataFrame) -> LanguageModel:
        """Learn from all ``text, lang`` rows (nulls in either are left out).

        Pieces of the distinct words are counted inside each task; the driver gets one count for each piece and
        language, which the vocabulary bounds.
        """
        path = self.tokenizer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, encoder = pieces(path).size, word_ids(path)
            counts: dict[str, np.ndarray] = {}
            for batch in batches:
                texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in text_slices(texts, 1 << 20):
                    found: dict[str, Counter] = {}
                    for text, lang in zip(texts[a:b], langs[a:b], strict=True):
                        found.setdefault(lang, Counter()).update(words_of(text))
                    for lang, words in found.items():
                        ids = encoder.of_words(list(words))
                        if ids:
                            times = np.repeat(list(words.values()), [len(x) // 4 for x in ids])
                            n = np.bincount(np.frombuffer(b"".join(ids), "<u4"), times, size)
                            counts[lang] = counts.get(lang, 0) + n
            for lang, n in counts.items():
                piece = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(piece), pa.string()), pa.array(piece), pa.array(n[piece].astype(np.int64))], ["lang", "piece", "n"])

        rows = labelled.select("text", "lang").where("text is not null and lang is not null")
        total = rows.mapInArrow(run, "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        found = total.toArrow()
        languages = sorted(set(found.column("lang").to_pylist()))
        counts = np.full((pieces(path).size, len(languages)), self.smoothing)
        place = {x: i for i, x in enumerate(languages)}
        columns = np.array([place[x] for x in found.column("lang").to_pylist()], int)
        counts[found.column("piece").to_numpy(), columns] += found.column("n").to_numpy()
        if not languages:
            return LanguageModel(path, languages, counts)
        chance, n = counts / counts.sum(axis=0), counts - self.smoothing
        saved = (n * np.log(chance * len(chance))).sum(axis=0) / (np.maximum(n.sum(axis=0), 1) * np.log(len(chance)))
        return LanguageModel(path, languages, chance, np.maximum(saved, 1e-9))

"""Token ids of whole texts by the tokenizers library, each distinct word once.

The public word vocabulary drops white space and never joins what stands on both sides of it, so the ids of a text are
those of its words in order; words are remembered up to a bound, which makes common ones cheap.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

from .common import text_slices

_SPACE = re.compile("[\n\t\r]")
#: ASCII punctuation after a letter or number: the vocabulary's rules cut there.
_EDGE = re.compile(r"[!-/:-@\[-^`{-~](?<=[^\W_].)")


class WordIds:
    """Remembers ``limit`` words used last, and up to as many used before them."""

    def __init__(self, path: str, limit: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(1 + max(vocabulary.values()), bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _split(self, text: str | None) -> list[str]:
        if not text:
            return []
        # letters there keep their kind in lower case and composed form; a special token may hold "<|"
        if (text.isascii() or max(text) <= "\xff") and "<|" not in text:
            text = _EDGE.sub(r" \g<0>", text.lower())
        return _SPACE.sub(" ", text).split(" ")

    def _learn(self, words: set[str]) -> None:
        new = []
        for word in words:
            ids = self.older.get(word)
            if ids is None:
                new.append(word)
            else:
                self.words[word] = ids
        new.sort()
        alone = [x for x in new if x.isalpha() and max(x) <= "\xff"]
        for i in range(0, len(alone), 4096):  # a word of letters ends where the first piece that ends words stands
            part = alone[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops, data, begin = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist(), ids.tobytes(), 0
            for word, stop in zip(part, stops, strict=True):
                self.words[word] = data[begin:stop]
                begin = stop
        rest = [x for x in new if not (x.isalpha() and max(x) <= "\xff")]
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for word, x in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                self.words[word] = array("I", x.ids).tobytes()

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of some words without white space in them."""
        found = list(map(self.words.get, words))
        if None in found:
            self._learn({w for w, x in zip(words, found, strict=True) if x is None})
            found = list(map(self.words.__getitem__, words))
            if len(self.words) > self.limit:
                self.words, self.older = {}, self.words
        return found

    def _slice(self, texts: list[str | None]) -> list[bytes]:
        words, ends = [], []
        for text in texts:
            words += self._split(text)
            ends.append(len(words))
        found = self.of_words(words)
        begin, out = 0, []
        for end in ends:
            out.append(b"".join(found[begin:end]))
            begin = end
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        out: list[bytes] = []
        for a, b in text_slices(texts, 1 << 20):
            out += self._slice(texts[a:b])
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The process's own; Spark's Python workers serve many tasks."""
    return WordIds(path)

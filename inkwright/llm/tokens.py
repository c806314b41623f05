"""Token ids of whole texts with a public tokenizer, by way of a bounded word cache.

The tokenizer drops white space and never merges across it, so the ids of a text are those of its
white-space-separated words, one after another. Words repeat far more than texts do, so each
worker keeps the ids of recent words (two generations of bounded size) and asks the tokenizers
library only for new ones, many in one call.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

END_ID = 1


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public vocabulary is; the file itself is never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words kept in each of the two generations of a worker's cache, and characters of text that are looked up together.
CACHE_WORDS, BATCH_CHARS = 320_000, 1 << 19

#: Texts with one of these go to the library whole: Python parts words there and the tokenizer does not, or the other way.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: How the tokens that end a word are marked in the vocabulary.
_WORD_END = "</w>"
_LATIN = re.compile("[\x00-\xff]*")
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!\"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]*)")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, without the end id."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cache_words
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.recent: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters alone: each is one word of the tokenizer, so many go in one call."""
        found = {}
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            # Offsets are not asked for: ids that end words part them.
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) - 1 == len(part) and cuts[-1] == len(ids):
                data, cuts = ids.tobytes(), (4 * cuts).tolist()
                found.update((w, data[a:b]) for w, a, b in zip(part, cuts, cuts[1:]))
            else:
                found.update((w, self._library(w)) for w in part)
        return found

    def _kept(self, words: set[str]) -> set[str]:
        """Words with no ids in either generation; those in the old one move to the recent one."""
        missing = words.difference(self.recent)
        again = {w: self.old[w] for w in missing if w in self.old}
        self.recent.update(again)
        return missing.difference(again)

    def _learn(self, words: set[str]) -> None:
        """See that the recent generation has the ids of all these words."""
        if len(self.recent) >= self.limit:
            self.old, self.recent = self.recent, {}
        new = self._kept(words)
        # Latin letters, then other ASCII marks: the tokenizer's own split, so either part has its ids alone.
        parts = [(w, *m.groups()) for w in new if (m := _SIMPLE.fullmatch(w))]
        self.recent.update(self._letters(list(self._kept({letters for _, letters, _ in parts}))))
        marks = {m: self._library(m) for m in {m for _, _, m in parts if m}}
        self.recent.update((w, self.recent[letters] + marks[m]) for w, letters, m in parts if m)
        self.recent.update((w, self._library(w)) for w in new.difference(self.recent))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text. Texts are taken about BATCH_CHARS characters at a time, each with one look at the cache."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= BATCH_CHARS:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        split = []
        for text in texts:
            if any(odd in text for odd in _ODD):
                split.append(None)
            else:  # in Latin texts Python and the tokenizer lower-case alike
                split.append((text.lower() if text.isascii() or _LATIN.fullmatch(text) else text).split())
        self._learn(set().union(*(s for s in split if s)))
        for text, words in zip(texts, split):
            yield self._library(text) if words is None else b"".join(map(self.recent.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker; workers outlive tasks, and so does the cache."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

"""Token ids of whole texts by the tokenizers library, with the ids of runs between white space remembered.

The vocabulary's normaliser and pre-tokenizer never join anything across white space, so the ids of a text are those of
its runs one after another. New runs are encoded by the library, many at a time; a run of letters with ASCII marks after it is
its letters and its marks. Letters alone are one pre-token, so many of them are encoded as one text and cut after each
token that ends a word. Texts with control characters that Python counts as white space, but the
vocabulary does not, or with İ, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import claim

#: Runs remembered by a worker, some 200 bytes each; beyond this it starts over.
MEMORY = 800_000
_ODD = re.compile("[\x1c-\x1f\u0130]")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts of other letters than Latin ones are not lower-cased beforehand.
_FOREIGN = re.compile("[\u0250-\U0010ffff]")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.memory = memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.lower = self._lowers()
        self.ends = self._word_ends()

    def _lowers(self) -> bool:
        one = lambda t: self.library.encode(t, add_special_tokens=False).ids
        return one("Word WORD ÄÉ") == one("word word äé")

    def _word_ends(self) -> np.ndarray | None:
        """By id, whether a token ends a word; None if the vocabulary does not say so."""
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        return ends

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, runs: list[str]) -> None:
        found = self.library.encode(runs, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        of = np.array([-1 if w is None else w for w in found.word_ids], dtype="int64")
        if (of < 0).any() or (np.diff(of) < 0).any():  # special strings inside: one by one
            self.known.update((r, self.whole(r)) for r in runs)
            return
        cuts = (np.searchsorted(of, np.arange(len(runs) + 1)) * 4).tolist()
        raw = ids.tobytes()
        self.known.update(zip(runs, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))

    def _learn_letters(self, words: list[str]) -> None:
        if self.ends is not None:
            for a in range(0, len(words), 20_000):
                part = words[a : a + 20_000]
                ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(part) or cuts[-1] != len(ids):
                    self._learn(part)
                    continue
                raw, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
                self.known.update(zip(part, (raw[x:y] for x, y in zip(at, at[1:]))))
        elif words:
            self._learn(words)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in bytes."""
        known = self.known
        split = [None if _ODD.search(t) else self._runs(t) for t in texts]
        new = set().union(*(x for x in split if x)).difference(known)
        if new:
            if len(known) + len(new) > self.memory:
                known.clear()
                new = set().union(*(x for x in split if x))
            letters, other, marked = set(), set(), []
            for r in new:
                word = r.rstrip(_MARKS)
                if not word.isalpha():
                    other.add(r)
                elif len(word) == len(r):
                    letters.add(r)
                else:
                    marked.append((r, word, r[len(word) :]))
                    letters.add(word)
                    other.add(r[len(word) :])
            # difference() looks these up in known; difference_update() would go through all of known
            self._learn_letters(sorted(letters.difference(known)))
            if other := other.difference(known):
                self._learn(sorted(other))
            known.update((r, known[word] + known[mark]) for r, word, mark in marked)
        return [self.whole(t) if x is None else b"".join(map(known.__getitem__, x)) for t, x in zip(texts, split)]

    def _runs(self, text: str) -> list[str]:
        if self.lower and "<|" not in text and (text.isascii() or not _FOREIGN.search(text)):
            text = text.lower()  # the vocabulary lower-cases too; special strings are matched before that
        return text.split()


_OPEN: dict[str, Encoder] = {}


def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """This process's encoder for a vocabulary file."""
    claim("tokens", _OPEN.clear)
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    _OPEN[path].memory = memory
    return _OPEN[path]

"""Token ids of texts, by a public tokenizer, with a bounded cache of words."""

from __future__ import annotations

import re

#: Letters that stay one letter when lower-cased; a run of them is one piece for the tokenizer.
PLAIN_WORD = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
#: Cached words in a worker, and bytes a cached word may take on average; the cache starts anew when either is used up.
CACHE_WORDS, WORD_BYTES = 600_000, 220
#: Bytes of the longest word that is kept beyond the call it occurs in, and of a cache entry besides word and ids.
LONGEST_WORD, ENTRY_BYTES = 64, 170


class WordTokens:
    """Ids of whole texts from ids of their words.

    For tokenizers that lower-case, drop white space and never merge across it, as
    ``word_bpe_49k.json`` does.  Unseen words that are one piece are encoded together in one
    text and cut where an id ends a word; all others are encoded one by one.
    """

    def __init__(self, path: str):
        import os

        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for piece, at in vocab.items():
            self.ends[at] = piece.endswith("</w>")
        self.known: dict[bytes, bytes] = {}
        self.most = CACHE_WORDS
        self.bytes = 0

    def ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def learn(self, words: set[bytes]) -> set[bytes]:
        """Ids of unseen words; returns all words that are known since."""
        import numpy as np

        plain, other = [], []
        for word in words:
            text = word.decode()
            (plain if PLAIN_WORD.fullmatch(text) else other).append((word, text))
        stems, ended = set(), []
        for word, text in other[:]:
            if text[-1] in ".," and PLAIN_WORD.fullmatch(text, 0, len(text) - 1):
                ended.append(word)
                if word[:-1] not in self.known and word[:-1] not in words:
                    stems.add((word[:-1], text[:-1]))
        plain += stems
        if plain:
            text = " ".join(t for _, t in plain)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(plain):
                raise ValueError("the tokenizer cuts plain words; it can't be used with a word cache")
            raw, start = ids.tobytes(), 0
            for (word, _), stop in zip(plain, cuts.tolist()):
                self.known[word] = raw[start:stop]
                start = stop
        marks = dict(zip((".", ","), self.ids([".", ","])))
        for word in ended:
            self.known[word] = self.known[word[:-1]] + marks[chr(word[-1])]
        done = set(ended)
        rest = [(w, t) for w, t in other if w not in done]
        for (word, _), ids in zip(rest, self.ids([t for _, t in rest])):
            self.known[word] = ids
        return words | {word for word, _ in stems}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        words = [t.lower().split() for t in texts]
        most = min(self.most, CACHE_WORDS)
        if len(self.known) > most or self.bytes > most * WORD_BYTES:
            self.known.clear()
            self.bytes = 0
        unseen: set[bytes] = set()
        for some in words:
            unseen.update(some)
        unseen.difference_update(self.known)
        added = self.learn(unseen) if unseen else ()
        known = self.known.__getitem__
        made = [b"".join(map(known, some)) for some in words]
        for word in added:
            if len(word) > LONGEST_WORD:
                del self.known[word]
            else:
                self.bytes += len(word) + len(self.known[word]) + ENTRY_BYTES
        return made


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str, cache_words: int = CACHE_WORDS) -> WordTokens:
    """One tokenizer and cache, of at most about ``cache_words`` words of WORD_BYTES bytes, per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    _LOADED[path].most = cache_words
    return _LOADED[path]

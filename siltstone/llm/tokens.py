"""Token ids by the ``tokenizers`` library, with a bounded cache of words.

A byte-level BPE vocabulary never merges across its pre-token bounds, and a
single space or line feed between two other characters always is one. So a
text without other white space is the concatenation of its words' ids; each
distinct word goes through the library once while it stays in the cache. All
other texts (double spaces or line feeds, tabs, special-token strings, a space at
the end or before a line feed) go through the library whole. Line feeds open a
piece of their own, so a word at a line's end is known whatever follows.
"""

from __future__ import annotations

import os
import re
from operator import itemgetter

import numpy as np

_OTHER_SPACE = re.compile(r"[^\S\n]")
_loaded: dict[str, "Encoder"] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Words kept, unless more are asked for; about 250 bytes each.
CACHE_WORDS = 900_000


def encoder(path: str, cache_words: int = CACHE_WORDS) -> "Encoder":
    """The process's encoder for a vocabulary file: workers are reused, so is the cache."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    _loaded[path].cache_words = cache_words
    return _loaded[path]


def forget() -> None:
    """Give up the words that this process keeps: other steps of a pipeline run in the same workers and need the memory."""
    for found in _loaded.values():
        found.forget()


class Encoder:
    #: Words kept. Beyond it the cache starts anew.
    cache_words = CACHE_WORDS
    #: Words joined into one string for the library.
    JOINED = 200

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        # Byte-level vocabularies spell each byte as one character.
        self.widths = np.zeros(self.size, np.int64)
        self.surface = [""] * self.size
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
            self.surface[i] = token
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.marks = {m: self.whole(m) for m in ".,\n"}
        #: Ids of words that follow a space; those that begin a line start with its line feed. None: the text is odd.
        self.known: dict[str, bytes | None] = {"\n": self.marks["\n"]}

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _is_odd(self, piece: str) -> bool:
        return not piece or _OTHER_SPACE.search(piece) is not None or any(s in piece for s in self.special)

    def _learn_words(self, new: list[str], lead: str) -> None:
        """Make words without white space known as they are after ``lead``, a space or a line feed."""
        texts = [lead + lead.join(new[at : at + self.JOINED]) for at in range(0, len(new), self.JOINED)]
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.empty(0, "<u4"), *(np.array(e.ids, "<u4") for e in found)])
        # Each word goes with what leads it: a space is in the word's first token, a line feed is a token of its own.
        sizes = np.array([len(w) if w.isascii() else len(w.encode()) for w in new], np.int64) + 1
        ends = 4 * (np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(sizes)) + 1)
        raw, ends = ids.tobytes(), ends.tolist()
        words = new if lead == " " else [lead + w for w in new]
        self.known.update(zip(words, map(raw.__getitem__, map(slice, [0, *ends], ends))))

    def _learn(self, pieces: set[str]) -> None:
        """Make pieces between single spaces known; a piece that begins a line has its line feed in front.

        A comma or full stop after a word of letters alone is a token of its own.
        """
        known, marks = self.known, self.marks
        spaced = set(filter(str.isalpha, pieces))
        first, cut = set(), []
        for piece in pieces - spaced:
            word = piece[1:] if piece[:1] == "\n" else piece
            if word[-1:] in marks and word[:-1].isalpha():
                cut.append(piece)
            elif self._is_odd(word):
                known[piece] = None
            elif word is piece:
                spaced.add(piece)
            else:
                first.add(word)
        for core in {piece[:-1] for piece in cut}.difference(known):
            first.add(core[1:]) if core[0] == "\n" else spaced.add(core)
        self._learn_words(list(spaced), " ")
        self._learn_words(list(first), "\n")
        known.update([(piece, known[piece[:-1]] + marks[piece[-1]]) for piece in cut])

    def forget(self) -> None:
        self.known.clear()
        self.known["\n"] = self.marks["\n"]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers; null is empty."""
        known = self.known
        if len(known) > self.cache_words:
            self.forget()
        # As if a line feed stood before each text: then each piece follows a space or begins with a line feed.
        split = [None if not t or "\n\n" in t or t[0] == "\n" else ("\n" + t.replace("\n", " \n")).split(" ") for t in texts]
        new = set().union(*filter(None, split)).difference(known)
        if new:
            self._learn(new)
        out = []
        for text, pieces in zip(texts, split):
            if pieces is None:
                out.append(self.whole(text) if text else b"")
                continue
            try:
                out.append(b"".join(itemgetter(*pieces, "\n")(known)[:-1])[4:])
            except TypeError:  # a piece is None
                out.append(self.whole(text))
        return out

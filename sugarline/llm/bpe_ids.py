"""Token ids of a byte-level BPE tokenizer, word by word.

The tokenizer cuts a text before every blank that follows anything but white space, so the ids of
such words can be kept. Other texts go to the tokenizer whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import islice

from sugarline.llm.tokens import _byte_letters

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_LETTERS_ONLY = re.compile(f"[{_LETTERS}]+")
#: What the tokenizer cuts apart inside a word: letters, digits, signs (no apostrophe, which may
#: start a contraction), and a line break between two of them.
_PIECE = f"[{_LETTERS}]+|[0-9]+|[!-&(-/:-@\\[-`{{-~]+"
_WORD = re.compile(f"(?:{_PIECE})+(?:\n(?:{_PIECE})+)*")
_SIGNS = tuple(".,;:!?")
_PIECES = re.compile(f"{_PIECE}|\n")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Whole(Exception):
    """A word cannot be cut out of its text."""


class _Kept(dict):
    """Ids by word. Words that were used since the last change of generation stay longest: when
    ``most`` are held they become the older generation, and the one before it goes."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.compute(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """Ids of texts, for a byte-level BPE tokenizer. Keeps the ids of twice ``most_words`` words of
    up to 64 characters (about 200 bytes each)."""

    def __init__(self, path: str, most_words: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: Type code of an id: 16 bits if all ids fit.
        self.code = "H" if vocabulary <= 1 << 16 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.words = _Kept(self._word, most_words)  # a blank and the word
        self.bare = _Kept(self._model, most_words // 8)  # a piece without a blank before it

    def of(self, text: str) -> bytes:
        """Ids of a whole text, little-endian."""
        words = text.split(" ")
        first = words[0]
        plain = _LETTERS_ONLY.fullmatch(first)
        # The blank after the first word ends it only if no white space stands before
        if not plain and first and len(words) > 1 and (first[-1].isspace() or any(s in first for s in self.special)):
            return self._encode(text)
        try:
            found = b"".join(map(self.words.__getitem__, islice(words, 1, None)))
        except _Whole:
            return self._encode(text)
        if not first:
            return found
        return (self.bare[first] if plain else self._encode(first)) + found

    def _encode(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, piece: str, blank: str = "") -> bytes:
        """Ids of one piece, in the letters that stand for its bytes."""
        if not piece.isascii() or piece == "\n":
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(blank + piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        if _LETTERS_ONLY.fullmatch(word):
            return self._model(word, self.letters[32])
        if word[-1:] in _SIGNS and _LETTERS_ONLY.fullmatch(word[:-1]):
            return self.words[word[:-1]] + self.bare[word[-1]]
        if any(s in word for s in self.special) or not word or word[-1].isspace():
            raise _Whole
        if not _WORD.fullmatch(word):
            return self._encode(" " + word)
        first, *rest = _PIECES.findall(word)
        ids = self.words[first] if rest else self._model(first, self.letters[32])
        return ids + b"".join(map(self.bare.__getitem__, rest))


@lru_cache(maxsize=1)
def byte_bpe(path: str) -> ByteBpe:
    """One per Python worker."""
    return ByteBpe(path)

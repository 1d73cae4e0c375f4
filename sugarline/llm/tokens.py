"""Token ids word by word, and token counts that follow edits.

The tokenizer splits at blanks before anything else, so the ids of a text are those of its
blank-separated words in a row. Words repeat; their ids are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarline.llm.common import BLANKS

#: Words of printable ASCII and Latin letters: the tokenizer changes nothing in them but the case,
#: and cuts them into runs of letters, single digits, and runs of other characters.
_LATIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u024f]+")
_SEGMENTS = re.compile(f"[^{BLANKS}]*[{BLANKS}]+|[^{BLANKS}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters
    for themselves, the others by the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordIds(dict):
    """Word (bytes) to its ids (little-endian unsigned 32 bits), for a tokenizer that ignores case
    and never joins across blanks. Forgets everything once its words take about ``most`` bytes;
    tasks empty it when they end."""

    def __init__(self, path: str, most: int = 96_000_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.held = Tokenizer.from_file(path), most, 0
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" not in text and _LATIN.fullmatch(text) and _LATIN.fullmatch(text := text.lower()):
            pieces = [p.encode() for p in _PIECES.findall(text)]
            if len(pieces) > 1:
                ids = b"".join(map(self.__getitem__, pieces))
            else:  # one piece goes straight to the model, in the letters that stand for its bytes
                found = self.model.tokenize("".join(map(self.letters.__getitem__, pieces[0])))
                ids = array("I", [t.id for t in found]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            if self.held > self.most:
                self.clear()
            self[word] = ids
            self.held += 160 + len(word) + len(ids)
        return ids

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def of(self, text: str) -> bytes:
        """Ids of a whole text."""
        data = text.encode()
        if b"<|" in data:  # may hold special tokens, which mind the case
            return b"".join(self[w if b"<|" in w else w.lower()] for w in data.split())
        return b"".join(map(self.__getitem__, data.lower().split()))

    def counts(self, text: str) -> np.ndarray:
        """Number of ids of each word."""
        data = text.encode()
        if b"<|" in data:
            words = [w if b"<|" in w else w.lower() for w in data.split()]
        else:
            words = data.lower().split()
        return np.fromiter(map(len, map(self.__getitem__, words)), np.int64, len(words)) // 4

    def count(self, text: str) -> int:
        return len(self.of(text)) // 4


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per Python worker and tokenizer file."""
    return WordIds(path)


class TokenTree:
    """Token count of a text under edits.

    Leaves are the words with the blanks after them; every inner node holds the characters and
    tokens below it. An edit re-encodes the leaves it touches, and the next ones for as long as no
    blank separates them, then updates the sums above.
    """

    def __init__(self, text: str, ids: WordIds):
        self.ids = ids
        self.parts = _SEGMENTS.findall(text)
        self.reencoded = 0
        n = len(self.parts)
        self.size = 1 << max(n - 1, 0).bit_length()
        self.chars, self.tokens = [np.zeros(2 * self.size, np.int64) for _ in range(2)]
        self.chars[self.size : self.size + n] = np.fromiter(map(len, self.parts), np.int64, n)
        counts = ids.counts(text)  # one for each word; a part of leading blanks has none
        self.tokens[self.size + n - len(counts) : self.size + n] = counts
        level = self.size
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(self.parts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at``, and the place in it; the last character's leaf for the end."""
        if at >= self.length:
            at, past = max(self.length - 1, 0), at - max(self.length - 1, 0)
        else:
            past = 0
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.chars[node]:
                at -= int(self.chars[node])
                node += 1
        return node - self.size, at + past

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.parts[leaf] = text
        node = leaf + self.size
        by_chars, by_tokens = len(text) - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += by_chars
            self.tokens[node] += by_tokens
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end`` (exclusive) by ``new``."""
        if not self.parts:
            self.parts = [""]
        first, at = self._leaf(start)
        # A character before may lack its blank only inside one leaf, so no leaf before is touched
        last, until = self._leaf(end)
        merged = self.parts[first][:at] + new + self.parts[last][until:]
        rest = last + 1
        while rest < len(self.parts) and merged and merged[-1] not in BLANKS:
            merged += self.parts[rest]
            rest += 1
        self.reencoded += len(merged.split())
        for leaf in range(first + 1, rest):
            if self.parts[leaf]:
                self._set(leaf, "", 0)
        self._set(first, merged, self.ids.count(merged))


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """Three edits that a text alone determines, each for the text after the ones before it: its
    first 32 characters go in at the middle, 32 go out at one quarter, and the first 16 replace 16
    at three quarters."""
    n = len(text)
    longer = n + len(text[:32])
    cut = min(longer, n // 4 + 32)
    shorter = longer - (cut - n // 4)
    at = min(3 * n // 4, shorter)
    return [(n // 2, n // 2, text[:32]), (n // 4, cut, ""), (at, min(at + 16, shorter), text[:16])]


def counted(docs: DataFrame, tokenizer: str | None = None, edits=sample_edits) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_words and n_reencoded for each row of ``docs``.

    ``edits`` gives the edits of a text. ``n_reencoded`` counts the words encoded again for them.
    A null text counts as empty; repeated rows get equal results; a long text is one tree; extra
    columns are ignored; no rows give no result.
    """
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("struct<n_tokens: bigint, n_tokens_edited: bigint, n_words: bigint, n_reencoded: bigint>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids = word_ids(path)
        try:
            for texts in batches:
                rows = []
                for text in texts:
                    tree = TokenTree(text or "", ids)
                    before, words = tree.total, len((text or "").encode().split())
                    for start, end, new in edits(text or ""):
                        tree.edit(start, end, new)
                    rows.append((before, tree.total, words, tree.reencoded))
                yield pd.DataFrame(rows, columns=["n_tokens", "n_tokens_edited", "n_words", "n_reencoded"])
        finally:
            ids.clear()

    return docs.select("doc_id", count(F.col("text")).alias("c")).select("doc_id", "c.*")

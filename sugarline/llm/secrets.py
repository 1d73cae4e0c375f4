"""Secret scans: fixed patterns, and strings that compress badly in a sensitive context.

A candidate string is compressed by zstandard with a dictionary primed with the text around it and
with common identifiers. Names and words find matches there and shrink; keys and passwords do not.
The marginal bytes per character decide.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarline.llm.common import release

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns, and the least size of a match (of group 2 for assign).
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ASSIGN_HINT = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
#: A maximal run that is long enough; shorter runs do not matter and are not visited one by one.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What may stand a little before a secret.
CONTEXT = re.compile(
    r"password|passwd|pwd|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization|signature", re.I | re.A
)
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: From so many literals on zstandard codes them by their frequencies; and the characters of a long
#: candidate that prime its next piece.
RAW, BACK = 64, 1000
#: Identifiers and file words that are no secrets (the dictionary's fixed part).
IDENTIFIERS = (
    "password secret token api_key access_key private_key client_id client_secret username user_id "
    "authorization bearer basic session cookie header value string config settings default example "
    "https://www.http://localhost/index.html/usr/local/bin/etc/ import from return function class public "
    "static void const self this null none true false int float bool list dict array object request "
    "response error message version license copyright abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "0123456789 00000000000000000000000000000000 xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 12345678901234567890"
).encode()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def novelty(candidate: str, around: bytes) -> float:
    """Bytes that a candidate adds, per character, to what the dictionaries already hold.

    Worked in pieces below ``RAW`` characters, each primed with the ``BACK`` characters before it:
    zstandard leaves so few literals as they are, so only matches make a string cheaper, not a small
    alphabet or a great length.
    """
    data = candidate.encode()
    pieces = -(-len(data) // (RAW - 1))
    cuts = [len(data) * i // pieces for i in range(pieces + 1)]
    added = 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        before = b"\n" + data[max(0, a - BACK) : a] if a else b""
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around + before, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(
            level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        added += len(packer.compress(data[a:b])) - len(packer.compress(b""))
    return added / len(data)


def _sensitive(text: str, reach: int) -> list[tuple[int, int]]:
    """Candidates that begin at most ``reach`` characters after a context word.

    A context word looks no further than its reach, and nothing is looked at again that an earlier
    one has found, so the time grows with the text alone.
    """
    found = []
    done = 0
    for hint in CONTEXT.finditer(text):
        window = hint.end() + reach
        done = max(hint.end(), done)
        while done <= window:
            m = CANDIDATE.search(text, done, window + LEAST)
            if m is None:
                break
            done = RUN.match(text, m.start()).end()
            found.append((m.start(), done))
    return found


def _touches(start: int, end: int, starts: list[int], longest: list[int]) -> bool:
    """Whether a span that begins before ``end`` goes past ``start``; ``longest`` is the furthest
    end among the spans up to each of the sorted ``starts``."""
    i = bisect_left(starts, end)
    return i > 0 and longest[i - 1] > start


def _by_start(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    spans = sorted(spans)
    return [a for a, _ in spans], list(accumulate((b for _, b in spans), max))


def _around(
    text: str, start: int, end: int, word: str, first: int, fixed: tuple[list[int], list[int]], width: int
) -> bytes:
    """``width`` characters on both sides, without the copies of the word that are secrets too: those
    from ``first`` on, or in a ``fixed`` span; also copies cut off at the ends."""

    def others(a: int, b: int) -> str:
        parts, at = [], a
        copy = text.find(word, max(0, a - len(word) + 1), b + len(word) - 1)
        while copy >= 0:
            past = copy + len(word)
            if copy >= first or _touches(copy, past, *fixed):
                parts.append(text[at : max(at, copy)])
                at = max(at, min(past, b))
            copy = text.find(word, past, b + len(word) - 1)
        return "".join(parts) + text[at:b]

    return (others(max(0, start - width), start) + "\n" + others(end, min(len(text), end + width))).encode()


def novelties(text: str, spans: list[tuple[str, int, int]], width: int = 400) -> list[float]:
    """Novelty of each span's string (of its value, for assign) in its surroundings."""
    if not spans:
        return []
    fixed = _by_start([(a, b) for _, a, b in spans])
    out = []
    for kind, start, end in spans:
        if kind == "assign":
            start = ASSIGN.match(text, start, end).start(2)
        word = text[start:end]
        out.append(novelty(word, _around(text, start, end, word, start, fixed, width)))
    return out


def novel_spans(text: str, taken: list[tuple[str, int, int]], reach: int = 48, width: int = 400, least: float = 0.8) -> list[tuple[str, int, int]]:
    """Incompressible strings with letters and digits at most ``reach`` characters after a context
    word. Strings that touch a span already ``taken`` are left out.

    Copies from the first one in a context on, and those in a ``taken`` span, do not make a string
    known; copies before do: such a string counts as a word of the text.
    """
    found = []
    places = _sensitive(text, reach)
    if not places:
        return found
    fixed = _by_start([(a, b) for _, a, b in taken])
    first: dict[str, int] = {}
    for start, end in places:
        first.setdefault(text[start:end], start)
    for start, end in places:
        word = text[start:end]
        if word.isalpha() or not any(c.isdigit() for c in word) or not any(c.isalpha() for c in word):
            continue
        if _touches(start, end, *fixed):
            continue

        if novelty(word, _around(text, start, end, word, first[word], fixed, width)) >= least:
            found.append(("novel", start, end))
    return found


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, each by start and then by kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + novel_spans(text, base), key=order)


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by ``mask``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel and novelty (bytes added per
    character, of each span in their order) for each row of ``docs``.

    A null text counts as empty and has no spans. Repeated rows get equal results; the time of a
    text grows with its length alone; extra columns are ignored; no rows give no result.
    """

    @F.pandas_udf("struct<n_assign: bigint, n_access: bigint, n_hex: bigint, base_sha256: string, spans: string, n_novel: bigint, novelty: array<double>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base, spans = scan(text or "")
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                added = [round(x, 3) for x in novelties(text or "", spans)]
                rows.append((*counts, digest, _joined(spans), len(spans) - len(base), added))
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "novelty"]
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", find(F.col("text")).alias("s")).select("doc_id", "s.*")


def redacted(text: Column) -> Column:
    """A text with its secrets masked; null stays null."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else redact(t, scan(t)[1]) for t in texts], dtype=object)
        release()

    return clean(text)

"""Exact token counts of a byte-level BPE at every prefix of a text, by dynamic programming.

A token sequence is the tokenizer's own exactly when each pair of neighbours
is.  So each prefix of a piece has one last token that fits the last token of
the prefix before it, and ``count[i] = count[i - len(last[i])] + 1``.  The
pieces of a text add up, so every prefix of the text has its count without
being encoded again: truncation and budgets are look-ups.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed values of the tokenizer's format: how it splits texts, and its printable bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
KEPT_PIECES = 500_000
#: Longer pieces are counted anew each time.
KEPT_LETTERS = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the tokenizer's file."""
    letters, other = [], 256
    for byte in range(256):
        if byte in PRINTABLE:
            letters.append(chr(byte))
        else:
            letters.append(chr(other))
            other += 1
    return letters


class PrefixCounter:
    """Token counts at every prefix, for one tokenizer file; pieces seen before are kept, up to a bound."""

    _open: dict[str, PrefixCounter] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = {letter: byte for byte, letter in enumerate(byte_letters())}
        as_bytes = lambda token: bytes(to_byte[letter] for letter in token)
        self.tokens = {as_bytes(token) for token in spec["model"]["vocab"]}
        pairs = (merge.split(" ") if isinstance(merge, str) else merge for merge in spec["model"]["merges"])
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}
        #: The merge that makes each token, -1 for a byte, and its two parts.
        self.made = {token: (-1, token, token) for token in self.tokens}
        for (a, b), k in self.rank.items():
            if self.made.get(a + b, (0,))[0] == -1:
                self.made[a + b] = (k, a, b)
        #: What tokens end in: from the end of a prefix back, no token begins before the first bytes not in here.
        self.endings = {token[k:] for token in self.tokens for k in range(len(token))}
        self.special = regex.compile("(" + "|".join(regex.escape(x["content"]) for x in spec["added_tokens"]) + ")") if spec["added_tokens"] else None
        self.split = regex.compile(SPLIT)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        #: What stands for a character when texts are split: itself if `regex` classes it as the library does.
        self.stand_in = {chr(c): chr(c) for c in range(128)}
        self.plain_letters = set(self.stand_in)
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, int] = {}
        self.tables: dict[str, array] = {}

    @classmethod
    def open(cls, path: str) -> PrefixCounter:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _fit(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay apart: undoing their merges from the last, none across the border came earlier."""
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= KEPT_PIECES:
                self.fits.clear()
            found = self.fits[key] = self._apart(left, right)
        return found

    def _apart(self, left: bytes, right: bytes) -> bool:
        limit = len(self.rank)
        while True:
            if self.rank.get((left, right), limit) < limit:
                return False
            (left_made, _, left_end), (right_made, right_start, _) = self.made[left], self.made[right]
            if left_made > right_made:
                limit, left = left_made, left_end
            elif right_made >= 0:
                # Merges of one rank go from left to right.
                limit, right = right_made + 1, right_start
            else:
                return True

    def byte_table(self, data: bytes) -> array:
        """Tokens of each of a piece's byte prefixes, from the empty one on."""
        n, tokens, endings, fits = len(data), self.tokens, self.endings, self.fits
        count, last = [0] * (n + 1), [b""] * (n + 1)
        for end in range(1, n + 1):
            starts, start = [], end - 1
            while start >= 0:
                ending = data[start:end]
                if ending not in endings:
                    break
                if ending in tokens:
                    starts.append(start)
                start -= 1
            for start in reversed(starts):  # the longest first
                token = data[start:end]
                if start:
                    fit = fits.get((last[start], token))
                    if not (self._fit(last[start], token) if fit is None else fit):
                        continue
                count[end], last[end] = count[start] + 1, token
                break
        return array("I", count)

    def _classes(self, chars: list[str]) -> list[str]:
        """For each character a letter, digit, sign or space, whichever the library's own splitter classes it with."""
        text = "".join(f"a{c} 1{c} !{c} " for c in chars)
        starts = {start for _, (start, _) in self.splitter.pre_tokenize_str(text)}
        # A character goes on the piece before it where the two are of one class.
        return [next((known for k, known in enumerate("a1!") if 9 * n + 3 * k + 1 not in starts), " ") for n in range(len(chars))]

    def shadow(self, text: str) -> str:
        """The text with a stand-in for each character that `regex` and the library class apart.

        The two follow different versions of Unicode; the library's word counts.
        """
        if text.isascii():
            return text
        new = set(text) - self.plain_letters
        if new:
            unseen = [c for c in new if c not in self.stand_in]
            for char, own in zip(unseen, self._classes(unseen), strict=True):
                agreed = {"a": r"\p{L}", "1": r"\p{N}", "!": r"[^\p{White_Space}\p{L}\p{N}]", " ": r"\p{White_Space}"}[own]
                self.stand_in[char] = char if regex.fullmatch(agreed, char) else {"a": "é", "1": "²", "!": "¡", " ": "\xa0"}[own]
            self.plain_letters.update(char for char in new if self.stand_in[char] == char)
            if not new <= self.plain_letters:
                return "".join(map(self.stand_in.__getitem__, text))
        return text

    def pieces(self, text: str) -> list[str]:
        """The library's pieces of a text without special strings."""
        shadow = self.shadow(text)
        found = self.split.findall(shadow)
        if shadow is text:
            return found
        ends = list(accumulate(map(len, found), initial=0))
        return [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def piece(self, piece: str) -> int:
        """Tokens of a whole piece."""
        found = self.known.get(piece)
        if found is None:
            found = self.byte_table(piece.encode())[-1]
            if len(piece) <= KEPT_LETTERS:
                if len(self.known) >= KEPT_PIECES:
                    self.known.clear()
                self.known[piece] = found
        return found

    def piece_table(self, piece: str) -> array:
        """Tokens of each of a piece's character prefixes."""
        found = self.tables.get(piece)
        if found is None:
            if len(self.tables) >= KEPT_PIECES // 10:
                self.tables.clear()
            by_byte = self.byte_table(piece.encode())
            ends = accumulate((len(c.encode()) for c in piece), initial=0)
            found = array("I", (by_byte[end] for end in ends))
            if len(piece) <= KEPT_LETTERS:
                self.tables[piece] = found
        return found

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and those strings (True)."""
        if self.special is None or not self.special.search(text):
            if text:
                yield text, False
            return
        for k, part in enumerate(self.special.split(text)):
            if part:
                yield part, bool(k % 2)

    def total(self, text: str) -> int:
        """The count at the last prefix: the pieces' own counts, summed up."""
        count, known = 0, self.known
        for segment, special in self.segments(text):
            if special:
                count += 1
                continue
            for piece in self.pieces(segment):
                found = known.get(piece)
                count += self.piece(piece) if found is None else found
        return count

    def prefixes(self, text: str) -> np.ndarray:
        """Token count of text[:i] for each i from 0 to its length.

        Only a prefix that ends within a run of white space or a contraction is
        split otherwise than the whole text: its run is one piece, its ``'l``
        or ``'r`` two.
        """
        parts, before, plain = [np.zeros(1, np.int64)], 0, ""
        for segment, special in self.segments(text):
            if special:
                # Until the string is complete its letters are ordinary text, one with what stands before them.
                counts = self._plain(plain + segment)[len(plain) + 1 :]
                base = before - self._plain(plain)[-1]
                counts = counts + base
                counts[-1] = before + 1
                plain = ""
            else:
                counts = before + self._plain(segment)[1:]
                plain = segment
            parts.append(counts)
            before = int(counts[-1])
        return np.concatenate(parts).astype(np.int32)

    def _plain(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int64)
        before, at = 0, 0
        for piece in self.pieces(text):
            end = at + len(piece)
            if piece in _CONTRACTIONS:
                for i in range(1, len(piece)):
                    out[at + i] = before + sum(map(self.piece, self.pieces(piece[:i])))
                out[end] = before + self.piece(piece)
            else:
                out[at : end + 1] = before + np.frombuffer(self.piece_table(piece), np.uint32)
            before, at = int(out[end]), end
        for run in regex.finditer(r"\p{White_Space}{2,}", self.shadow(text)):
            start, stop = run.span()
            out[start : stop + 1] = out[start] + np.frombuffer(self.piece_table(text[start:stop]), np.uint32)
        return out

    def longest_within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefixes(text) <= budget)[-1]) if budget >= 0 else 0


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row's whole text.

    A null text counts as empty (0 bytes, 0 tokens).  Repeated rows are counted
    each; an empty table gives no rows; other columns are not read.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        counter = PrefixCounter.open(path)
        for batch in batches:
            counts = [counter.total(text) if text else 0 for text in batch.column(1).to_pylist()]
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            counts = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts, pc.greater(counts, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def prefix_token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None, path: str | None = None) -> DataFrame:
    """``doc_id, prefix_tokens`` with the count at each character prefix; with a budget also ``kept_chars``.

    ``prefix_tokens[i]`` belongs to the first i characters.  A null text is empty.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        counter = PrefixCounter.open(path)
        for batch in batches:
            tables = [counter.prefixes(text or "") for text in batch.column(1).to_pylist()]
            kept = [None if budget is None else int(np.flatnonzero(x <= max(0, budget))[-1]) for x in tables]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tables, pa.list_(pa.int32())), pa.array(kept, pa.int64())], names=["doc_id", "prefix_tokens", "kept_chars"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, prefix_tokens array<int>, kept_chars bigint")

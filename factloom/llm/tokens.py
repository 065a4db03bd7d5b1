"""Encoding of texts by a byte-level BPE vocabulary, exactly and in linear time.

Merging a word by rank takes time that grows with the square of its length. The encoder here
backtracks instead. An Aho-Corasick automaton over all tokens finds the longest token at each
place of a word; it is taken if it is *compatible* with the token before it, that is, if
merging the two tokens' bytes gives these two tokens again. If not, the next shorter token at
that place is tried, and if none is left, the token before is given up and the place marked as
one from which nothing leads on. Each place is marked at most once, so the time is linear; and
a row of tokens whose neighbours are all compatible is the exact result of merging.

Whether a pair is compatible is found by undoing the tokens' own merges along the border and
is kept in a table. Words are kept as well. Both tables have a fixed greatest size and are
emptied when full, which changes no result.

Decoding takes each id's bytes from one string of all tokens by a table of offsets.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import importable

#: Fixed value: how texts are cut into words before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the white space of PATTERN's \s, as a class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A coarser cut whose borders are borders of PATTERN too, unless a number that is no decimal digit stands there.
CHUNKS = rf" ?[^\d{SPACE}]+| ?\d+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Where the vocabularies lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Entries that a table of the encoder holds at most.
MEMO = 1 << 18
#: Longest chunk, in characters, that is kept.
CHUNK = 64


class Memo(dict):
    """Chunks and their results; emptied when full. Long chunks are not kept."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, chunk: str) -> bytes | None:
        got = self.compute(chunk)
        if len(chunk) <= CHUNK:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = got
        return got


class Vocabulary:
    """An encoder and decoder for ranked byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import ahocorasick
        import regex

        self.ranks = ranks
        self.words = regex.compile(pattern).findall
        self.chunks = re.compile(CHUNKS).findall
        self.token = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        self._memo = Memo(self._chunk)

    def halves(self, i: int) -> tuple[int, int] | None:
        """The two tokens that were merged into token i; None for a single byte."""
        if i not in self._halves:
            whole = self.token[i]
            parts = [whole[k : k + 1] for k in range(len(whole))]
            while len(parts) > 2:
                ranked = [(r, k) for k in range(len(parts) - 1) if (r := self.ranks.get(parts[k] + parts[k + 1], i)) < i]
                if not ranked:
                    break
                _, k = min(ranked)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self._halves[i] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[i]

    def _made(self, left: int, right: int) -> int | None:
        i = self.ranks.get(self.token[left] + self.token[right])
        return i if i is not None and self.halves(i) == (left, right) else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives [left, right]."""
        known = self._pairs.get((left, right))
        if known is not None:
            return known
        a, b = left, right
        before: float = float("inf")  # a merge across the border counts if its rank is below this
        answer = None
        while answer is None:
            made = self._made(a, b)
            if made is not None and made < before:
                answer = False
                break
            # Go back to before the later of the two merges; at equal ranks the left one came first.
            for side in ("left", "right") if a > b else ("right", "left"):
                parts = self.halves(a if side == "left" else b)
                if parts and side == "left":
                    before, a = a, parts[1]
                    break
                if parts:
                    before, b = b + 1, parts[0]
                    break
            else:
                answer = True
        if len(self._pairs) >= MEMO:
            self._pairs.clear()
        self._pairs[left, right] = answer
        return answer

    def shorter(self, i: int) -> int:
        """The longest token that token i begins with, itself excepted; -1: none."""
        if i not in self._shorter:
            t = self.token[i]
            self._shorter[i] = next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), -1)
        return self._shorter[i]

    def encode_word(self, data: bytes) -> list[int]:
        """The exact ids of one word."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [0] * n
        for end, i in self.automaton.iter(data.decode("latin-1")):  # longer tokens of a start come later
            longest[end + 1 - len(self.token[i])] = i
        out: list[int] = []
        lost = bytearray(n + 1)
        at, i = 0, longest[0]
        while True:
            end = at + len(self.token[i])
            if not lost[end] and (not out or self.compatible(out[-1], i)):
                out.append(i)
                at = end
                if at == n:
                    return out
                i = longest[at]
                continue
            i = self.shorter(i)
            if i < 0:
                lost[at] = 1
                i = out.pop()
                at -= len(self.token[i])

    def _chunk(self, chunk: str) -> bytes | None:
        """The ids of a chunk as little-endian 32-bit integers; None if its borders may be none of a word's."""
        return None if any(unicodedata.category(c) in ("Nl", "No") for c in (chunk[0], chunk[-1])) else self._exact(chunk)

    def _exact(self, text: str) -> bytes:
        ids = [i for w in self.words(text) for i in self.encode_word(w.encode("utf-8", "surrogatepass"))]
        return np.array(ids, dtype="<i4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; empty for empty and null texts."""
        if not text:
            return np.empty(0, dtype="<i4")
        try:
            data = b"".join(map(self._memo.__getitem__, self.chunks(text)))
        except TypeError:  # a chunk that may not stand alone
            data = self._exact(text)
        return np.frombuffer(data, dtype="<i4")

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids."""
        blob, offset = self._table()
        return b"".join([blob[offset[i] : offset[i + 1]] for i in ids])

    @lru_cache(maxsize=1)  # noqa: B019
    def _table(self) -> tuple[bytes, list[int]]:
        offset, parts = [0], []
        for i in range(max(self.token) + 1):
            parts.append(self.token.get(i, b""))
            offset.append(offset[-1] + len(parts[-1]))
        return b"".join(parts), offset


@lru_cache(maxsize=4)
def vocabulary(name: str, folder: str = TOKENIZERS) -> Vocabulary:
    """The vocabulary of a rank file (one base64 token and its rank per line)."""
    ranks = {}
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return Vocabulary(ranks)


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of each row's text, one row per input row, without a shuffle.

    Null and empty texts give an empty list. Strings of special tokens are ordinary text.
    Repeated keys keep their rows; a null key stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, folder)
        for batch in batches:
            ids = [v.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            values = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=[key, "ids"])

    importable(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, into: str = "tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """df with the number of tokens of a text column (bigint; 0 for empty and null texts) in place of the text."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, folder)
        for batch in batches:
            n = pa.array([len(v.encode(t)) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, into])

    importable(df.sparkSession)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{schema}{', ' * bool(keep)}`{into}` bigint")

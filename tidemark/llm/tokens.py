"""Byte-level BPE encoding of a corpus, exact and in linear time.

Bytes are read as Latin-1 text, so one Aho-Corasick trie of the vocabulary yields the longest token at a place. A piece is encoded
by taking longest matches and stepping back to the next shorter prefix token (or over the last token) whenever two neighbours
can't be adjacent in the merges' result; whether a pair can be adjacent follows from undoing the merges and is memoised, and so is
each place known to lead nowhere, so every place is visited a bounded number of times. The result equals applying the merges by rank.

Text is first split by the vocabulary's pattern; pieces repeat, so their ids are kept in a bounded cache.

Defined cases: empty and null texts give an empty list; special tokens' strings are ordinary text; texts of any length are encoded
whole; repeated rows each come out; further columns are ignored.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_FOLDER = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same on ASCII text, where classes are ranges and the standard library's faster engine serves.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
CACHE_PIECES, CACHE_LENGTH = 400_000, 48


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.size = len(ranks)
        self.text: list[str] = [""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.text[i] = b.decode("latin-1")
        self.id = {t: i for i, t in enumerate(self.text) if t}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.id.items():
            self.trie.add_word(t, i)
        self.longest = max(map(len, self.id))
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(self.text))]
        self.merge: dict[tuple[int, int], int] = {}
        for i in sorted(self.id.values()):
            if len(self.text[i]) > 1:
                a, b = self._halves(self.text[i], i)
                self.split[i] = (a, b)
                self.merge[a, b] = i
        self.shorter: list[int] = [-1] * len(self.text)
        for t, i in self.id.items():
            for n in range(len(t) - 1, 0, -1):
                if (j := self.id.get(t[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _halves(self, t: str, rank: int) -> tuple[int, int]:
        """The two tokens that the merge of this rank joins: the merges of lower rank applied to its bytes."""
        parts = [self.id[c] for c in t]
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                r = self.id.get(self.text[parts[k]] + self.text[parts[k + 1]], rank)
                if r < best:
                    best, at = r, k
            if at < 0:
                raise ValueError(f"token {rank} isn't a merge of two tokens")
            parts[at : at + 2] = [best]
        return parts[0], parts[1]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the merges can leave these two tokens side by side."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._adjacent(left, right)
        return known

    def _adjacent(self, left: int, right: int) -> bool:
        limit = len(self.text)  # merges of this rank and later happen after the two meet
        while True:
            if self.merge.get((left, right), limit) < limit:
                return False
            if left > right:  # the later of the two merges is undone
                limit = left
                left = self.split[left][1]
                if left == limit:
                    limit = right + 1
                    right = self.split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = self.split[right][0]
                if right + 1 == limit:
                    limit = left
                    left = self.split[left][1]
                    if left == limit:
                        return True

    def piece(self, raw: str) -> tuple[int, ...]:
        """Ids of one piece, given as Latin-1 text of its bytes."""
        whole = self.id.get(raw)
        if whole is not None:
            return (whole,)
        out: list[int] = []
        at, end = 0, len(raw)
        dead = bytearray(end + 1)
        token = self._longest(raw, 0)
        while at < end:
            left = out[-1] if out else -1
            while True:
                after = at + len(self.text[token])
                if not dead[after] and (left < 0 or self.adjacent(left, token)):
                    out.append(token)
                    at = after
                    if at < end:
                        token = self._longest(raw, at)
                    break
                if self.shorter[token] >= 0:
                    token = self.shorter[token]
                    continue
                dead[at] = 1
                token = out.pop()
                at -= len(self.text[token])
                break
        return tuple(out)

    def _longest(self, raw: str, at: int) -> int:
        window = raw[at : at + self.longest]
        n = self.trie.longest_prefix(window)
        i = self.id.get(window[:n])
        while i is None:  # the trie's path may end inside a longer token
            n -= 1
            i = self.id.get(window[:n])
        return i

    def learn(self, piece: str) -> tuple[int, ...]:
        ids = self.piece(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
        if len(piece) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def splitter() -> Callable[[str], list[str]]:
    import re

    import regex

    plain, full = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall
    return lambda s: plain(s) if s.isascii() else full(s)


_worker: dict[int, tuple[BytePairEncoder, Callable]] = {}


def _encoder(raw: bytes) -> tuple[BytePairEncoder, Callable]:
    """One encoder for each Python worker process."""
    key = hash(raw)
    if key not in _worker:
        _worker[key] = BytePairEncoder(read_ranks(raw)), splitter()
    return _worker[key]


def encode_texts(enc: BytePairEncoder, split: Callable, texts: pa.Array) -> tuple[array, array]:
    """Flat ids of the texts and the offsets of each."""
    flat, offsets, cache = array("i"), array("i", [0]), enc.cache
    for text in texts:
        s = text.as_py()
        if s:
            for p in split(s):
                ids = cache.get(p)
                if ids is None:
                    ids = enc.learn(p)
                flat.extend(ids)
        offsets.append(len(flat))
    return flat, offsets


def count_texts(enc: BytePairEncoder, split: Callable, texts: pa.Array) -> list[int]:
    out, cache = [], enc.cache
    for text in texts:
        n, s = 0, text.as_py()
        if s:
            for p in split(s):
                ids = cache.get(p)
                n += len(ids) if ids is not None else len(enc.learn(p))
        out.append(n)
    return out


def _vocabulary(df: DataFrame, path: str | None):
    """The rank file, under a megabyte, sent to the executors once."""
    with open(path or os.path.join(TOKENIZER_FOLDER, RANKS), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", *, path: str | None = None) -> DataFrame:
    """Columns: `key`, `ids`. No shuffle: texts are encoded where they are read."""
    raw = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, split = _encoder(raw.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                flat, offsets = encode_texts(enc, split, part.column(1))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keys: list[str], text: str = "text", *, path: str | None = None) -> DataFrame:
    """Columns: `keys`, `n_tokens`, without building the ids."""
    raw = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, split = _encoder(raw.value)
        for b in batches:
            n = count_texts(enc, split, b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keys, "n_tokens"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, f"{kinds}, n_tokens bigint")

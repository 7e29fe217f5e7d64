"""Byte-level BPE encoding and decoding as a tree reduction (operator 7).

A text's encoding is a monoid product of the encodings of its parts: a text of more than ``LEAF`` characters is halved until
its parts are short, each leaf is encoded alone, and two neighbours are joined at two levels.

*Pre-tokens.* Matches of the pattern have no memory, so the split is certain from any true start on. The left part's matches
that touch the border, or begin so near to it that they may look over it, are dropped; matching goes on from there, in a
window that grows match by match, until a match begins where one of the right part begins. From there on both splits agree.

*Tokens of a long pre-token.* A sequence of tokens is the encoding of its bytes if and only if each pair of neighbours is the
encoding of its own bytes: up to the first merge over a border between two tokens, their bytes merge as they do alone, so
that merge would happen in the pair too. The window around the border is therefore merged anew, twice as wide each time,
until the pairs at both of its edges are stable; all tokens outside then stay, whatever the text's length and script.

Decoding walks the same tree and concatenates the bytes of the parts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import per_batch, table

LEAF = 1024
#: How far a match may look ahead from its start besides its own run and one character: the longest contraction, ``'re``.
LOOK = 3
#: Bytes up to which a piece is merged by plain search, characters of a piece that is remembered, and half the pieces remembered.
SHORT, KNOWN_CHARS, KNOWN = 24, 32, 1 << 18
#: No rank.
NONE = 1 << 62


@lru_cache(maxsize=1)
def _newer() -> str:
    """Ranges of letters and numbers by the ``regex`` module's Unicode version that the tiktoken library's older one calls neither.

    Only code points that Python itself has not assigned are in question; the library is asked about each of them, by whether
    it keeps the character and a mark behind it in one pre-token.
    """
    import unicodedata

    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {bytes([i, 33]): 128 + i for i in range(128, 256)}
    probe = tiktoken.Encoding("probe", pat_str=r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={})
    word = regex.compile(r"[\p{L}\p{N}]")
    asked = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn" and word.match(c)]
    found = [ord(c) for c in asked if len(probe.encode_ordinary(c + "!")) == len(c.encode())]
    first = [c for c, before in zip(found, [-1, *found]) if c != before + 1]
    last = [c for c, after in zip(found, [*found[1:], -1]) if c != after - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))


class Codec:
    """Encodes and decodes with a rank file. ``leaf`` only sets the size of the parts, never the result."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF) -> None:
        with open(ranks_path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes[rank] = piece
        self.leaf = max(leaf, 2 * LOOK)
        self.pattern = regex.compile(pattern)
        newer = _newer()
        self.newer = regex.compile(f"[{newer}]") if newer else None
        older = pattern.replace(r"\p{L}", f"[\\p{{L}}--[{newer}]]").replace(r"\p{N}", f"[\\p{{N}}--[{newer}]]") if newer else pattern
        self.older = regex.compile(older, regex.V1)
        self.known: dict[str, tuple[int, ...]] = {}
        self.once: dict[str, tuple[int, ...]] = {}
        self.sizes: dict[str, int] = {}
        self.sizes_once: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Merges the neighbours of least rank, the leftmost of equals, until no two of them make a token."""
        if len(data) > SHORT:
            return self._merge_queued(data)
        rank = self.ranks.get
        starts = list(range(len(data) + 1))
        found = [rank(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while found:
            least = min(found)
            if least == NONE:
                break
            i = found.index(least)
            del starts[i + 1], found[i]
            if i < len(found):
                found[i] = rank(data[starts[i] : starts[i + 2]], NONE)
            if i:
                found[i - 1] = rank(data[starts[i - 1] : starts[i + 1]], NONE)
        ranks = self.ranks
        return [ranks[data[a:b]] for a, b in zip(starts, starts[1:])]

    def _merge_queued(self, data: bytes) -> list[int]:
        """As ``_merge``, with the candidates in a heap."""
        ranks, size = self.ranks, len(data)
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := end[i]) < size and (rank := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(size - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, -1
            if k < size:
                before[k] = i
            offer(i)
            offer(before[i])
        out, i = [], 0
        while i < size:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _stable(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their own bytes."""
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= KNOWN:
                self.pairs.clear()
            found = self.pairs[a, b] = self._merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The merges of a pre-token's bytes from those of its two parts."""
        if not left or not right or self._stable(left[-1], right[0]):
            return left + right
        reach = 2
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = self._merge(b"".join([self.bytes[t] for t in (*left[a:], *right[:b])]))
            if (a == 0 or self._stable(left[a - 1], window[0])) and (b == len(right) or self._stable(window[-1], right[b])):
                return left[:a] + window + right[b:]
            reach *= 2

    def _merge_tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self._merge(data)
        middle = len(data) // 2
        return self.join_tokens(self._merge_tree(data[:middle]), self._merge_tree(data[middle:]))

    def piece(self, text: str) -> tuple[int, ...]:
        """The tokens of one pre-token: itself if it is a token, else by merges."""
        if (found := self.known.get(text)) is None:
            if (found := self.once.get(text)) is None:
                found = tuple(self._tokens(text))
            if len(text) <= KNOWN_CHARS:
                if len(self.known) >= KNOWN:  # what is asked for again comes back from there
                    self.known, self.once = {}, self.known
                self.known[text] = found
        return found

    def _tokens(self, text: str) -> list[int]:
        data = text.encode()
        rank = self.ranks.get(data)
        return self._merge_tree(data) if rank is None else [rank]

    def counts(self, found: list[str]) -> list[int]:
        """The numbers of tokens of pre-tokens; twice as many are remembered, as a number takes less room than the tokens."""
        out = list(map(self.sizes.get, found))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    out[i] = self._size(found[i])
        return out

    def _size(self, text: str) -> int:
        if (n := self.sizes.get(text) or self.sizes_once.get(text)) is None:
            n = len(self._tokens(text))
        if len(text) <= KNOWN_CHARS:
            if len(self.sizes) >= 2 * KNOWN:
                self.sizes, self.sizes_once = {}, self.sizes
            self.sizes[text] = n
        return n

    def split(self, text: str) -> list[str]:
        return self.splitter(text).findall(text)

    def splitter(self, text: str) -> regex.Pattern:
        if text.isascii() or self.newer is None:
            return self.pattern
        try:
            text.encode("latin-1")  # no newer character is that low, and this is the faster test
        except UnicodeEncodeError:
            return self.older if self.newer.search(text) else self.pattern
        return self.pattern

    def pieces(self, found: list[str]) -> list[tuple[int, ...]]:
        out = list(map(self.known.get, found))
        if None in out:
            return [t or self.piece(p) for p, t in zip(found, out)]
        return out

    def _parts(self, text: str, split: regex.Pattern, start: int, end: int) -> tuple[list[int], list[tuple[int, ...]]]:
        """Where the pre-tokens of text[start:end] begin, and their tokens."""
        if end - start <= self.leaf:
            found = split.findall(text[start:end])
            if sum(map(len, found)) == end - start:
                return list(accumulate(map(len, found[:-1]), initial=start))[: len(found)], self.pieces(found)
            spans = [m.span() for m in split.finditer(text[start:end])]  # a pattern that passes over characters
            return [start + a for a, _ in spans], self.pieces([text[start + a : start + b] for a, b in spans])
        middle = (start + end) // 2
        return self._join(text, split, self._parts(text, split, start, middle), self._parts(text, split, middle, end), start, middle, end)

    def _join(self, text: str, split: regex.Pattern, left: tuple, right: tuple, start: int, middle: int, end: int) -> tuple[list[int], list[tuple[int, ...]]]:
        starts, tokens = left
        rights, right_tokens = right
        kept = len(starts)
        while kept and (starts[kept] if kept < len(starts) else middle) > middle - LOOK:
            kept -= 1
        at = starts[kept] if kept < len(starts) else middle if starts else start
        out_starts, out_tokens, j = starts[:kept], tokens[:kept], 0
        for match in split.finditer(text, at, end):
            a, b = match.span()
            while j < len(rights) and rights[j] < a:
                j += 1
            if j < len(rights) and rights[j] == a:
                return out_starts + rights[j:], out_tokens + right_tokens[j:]
            out_starts.append(a)
            out_tokens.append(self._over(text, a, b, middle, end, starts, tokens, rights, right_tokens))
        return out_starts, out_tokens

    def _over(self, text: str, a: int, b: int, middle: int, end: int, starts: list[int], tokens: list, rights: list[int], right_tokens: list) -> tuple[int, ...]:
        """The tokens of the pre-token text[a:b]; of a long one over the border by joining those of its two parts."""
        if a < middle < b and b - a > self.leaf and starts and starts[-1] == a:
            j = bisect_left(rights, b)
            if (j == len(rights) and b == end) or (j < len(rights) and rights[j] == b):
                data = text[a:b].encode()
                if data in self.ranks:
                    return (self.ranks[data],)
                whole = list(tokens[-1])
                for part in right_tokens[:j]:
                    whole = self.join_tokens(whole, list(part))
                return tuple(whole)
        return self.piece(text[a:b])

    def encode(self, text: str) -> np.ndarray:
        split = self.splitter(text)
        parts = self.pieces(split.findall(text)) if len(text) <= self.leaf else self._parts(text, split, 0, len(text))[1]
        return np.fromiter(chain.from_iterable(parts), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            table_ = self.bytes
            return b"".join([table_[i] for i in ids.tolist()])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str, leaf: int = LEAF) -> Codec:
    return Codec(ranks_path, pattern, leaf)


def _named(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def with_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row for each input row: its id, ``ids`` (array of int) and ``decoded`` (binary, made from the ids alone).

    A null text counts as empty; an empty text has no ids and decodes to no bytes. Whole texts are encoded, in tree parts.
    ``vocabulary`` is a file of the tokenizer package, looked up on the executor. Other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = codec(*_named(vocabulary), leaf)
        ids = [tool.encode(text or "") for text in batch.column(1).to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([tool.decode(x) for x in ids], pa.binary())],
            names=[id_col, "ids", "decoded"],
        )

    slim = docs.select(F.col(id_col), F.col(text_col))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(per_batch(run, 256), f"`{id_col}` {kind}, ids array<int>, decoded binary")


def token_digests(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """As ``with_tokens``, but the digests of ids and bytes are taken beside the codec, so no ids leave the worker."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = codec(*_named(vocabulary), leaf)
        counts, id_sums, byte_sums = [], [], []
        for text in batch.column(1).to_pylist():
            ids = tool.encode(text or "")
            counts.append(len(ids))
            id_sums.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            byte_sums.append(hashlib.sha256(tool.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(byte_sums, pa.string())],
            names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    slim = docs.select(F.col(id_col), F.col(text_col))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(per_batch(run), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))

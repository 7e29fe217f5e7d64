"""Edit-aware token counts over pre-token segment trees (operator 4).

A text is cut into segments at pre-token borders, so its token count is the sum of its segments' counts. The segments are the
nodes of a balanced tree that holds the sums of characters and tokens below each node. An edit takes out of the tree the
segments it touches, and one more on its left where a match there may look into it; matching goes on over the segments behind
the edit until a pre-token begins where a segment does, from where on nothing changes. The text taken out is cut and encoded
anew, and its segments are put back; sums change on the paths to them only. Trees are kept as a column of segments, and edits
are applied to kept trees without encoding the text again.
"""

from __future__ import annotations

import random
from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.bpe import LOOK, Codec, _named, codec
from tessera.llm.common import per_batch, table

#: Characters from which on a segment ends at the next pre-token border.
SEGMENT = 256
SEGMENTS = "array<struct<chars:int,tokens:int>>"


class _Node:
    __slots__ = ("part", "count", "chars", "tokens", "rank", "left", "right")

    def __init__(self, part: str, count: int, rank: float) -> None:
        self.part, self.count, self.rank = part, count, rank
        self.left: _Node | None = None
        self.right: _Node | None = None
        self.sum()

    def sum(self) -> _Node:
        left, right = self.left, self.right
        self.chars = len(self.part) + (left.chars if left else 0) + (right.chars if right else 0)
        self.tokens = self.count + (left.tokens if left else 0) + (right.tokens if right else 0)
        return self


def _merged(a: _Node | None, b: _Node | None) -> _Node | None:
    """The tree of the segments of ``a``, then those of ``b``; heap order by rank keeps it balanced."""
    if a is None or b is None:
        return a or b
    if a.rank < b.rank:
        a.right = _merged(a.right, b)
        return a.sum()
    b.left = _merged(a, b.left)
    return b.sum()


def _split(node: _Node | None, chars: int) -> tuple[_Node | None, _Node | None]:
    """The segments that begin before ``chars``, and the others."""
    if node is None:
        return None, None
    before = node.left.chars if node.left else 0
    if before >= chars:
        left, node.left = _split(node.left, chars)
        return left, node.sum()
    node.right, right = _split(node.right, chars - before - len(node.part))
    return node.sum(), right


def _segments(root: _Node | None) -> list[_Node]:
    out, path = [], []
    while root or path:
        while root:
            path.append(root)
            root = root.left
        out.append(root := path.pop())
        root = root.right
    return out


def segments_of(tool: Codec, pieces: list[str], segment: int = SEGMENT) -> list[tuple[int, int]]:
    """(characters, tokens) of the segments of a text, given as its pre-tokens."""
    ends = list(accumulate(map(len, pieces)))
    counts = list(accumulate(tool.counts(pieces), initial=0))
    out, at, start = [], 0, 0
    while at < len(pieces):
        until = min(bisect_left(ends, start + segment), len(pieces) - 1) + 1
        out.append((ends[until - 1] - start, counts[until] - counts[at]))
        at, start = until, ends[until - 1]
    return out


class TokenTree:
    """Token counts of one text under edits. ``reencoded`` counts the characters encoded since the start."""

    def __init__(self, text: str, tool: Codec, segment: int = SEGMENT, kept: Sequence[tuple[int, int]] | None = None) -> None:
        """``kept`` are the (characters, tokens) of the text's segments, from ``segments``: then nothing is encoded."""
        self.tool, self.segment, self.reencoded = tool, segment, 0
        self.random = random.Random(4)
        if kept is None:
            kept = segments_of(tool, tool.split(text), segment)
            self.reencoded = len(text)
        elif sum(n for n, _ in kept) != len(text):
            raise ValueError("these segments are of another text")
        self.root = self._tree(text, kept)

    def _tree(self, text: str, kept: Sequence[tuple[int, int]]) -> _Node | None:
        """A balanced tree of segments; a node's rank is above its children's."""
        ends = list(accumulate((n for n, _ in kept), initial=0))

        def between(low: int, high: int, depth: int) -> _Node | None:
            if low >= high:
                return None
            middle = (low + high) // 2
            node = _Node(text[ends[middle] : ends[middle + 1]], kept[middle][1], depth + self.random.random())
            node.left, node.right = between(low, middle, depth + 1), between(middle + 1, high, depth + 1)
            return node.sum()

        return between(0, len(kept), 0)

    def replace(self, start: int, length: int, new: str) -> None:
        """Replaces ``length`` characters from ``start`` on; both are held to the text's bounds."""
        total = self.root.chars if self.root else 0
        start = min(max(start, 0), total)
        end = min(start + max(length, 0), total)
        # Left of the edit: whole segments, the last of which may look LOOK characters into the next one.
        touched, after = _split(self.root, end + 1)
        before, touched = self._before(touched, start)
        part = "".join(n.part for n in _segments(touched))
        offset = before.chars if before else 0
        text = part[: start - offset] + new + part[end - offset :]
        # Right of it: until a pre-token begins where a segment does.
        while True:
            beside, rest = _split(after, LOOK + 1)  # so that no match before them ends where the text seems to
            behind = "".join(n.part for n in _segments(beside))
            pieces = self.tool.split(text + behind[: 4 * LOOK])
            ends = list(accumulate(map(len, pieces), initial=0))
            at = bisect_left(ends, len(text))
            if ends[at] == len(text):
                after = _merged(beside, rest)
                break
            text, after = text + behind, rest
        self.reencoded += len(text)
        self.root = _merged(_merged(before, self._tree(text, segments_of(self.tool, pieces[:at], self.segment))), after)

    def _before(self, node: _Node | None, start: int) -> tuple[_Node | None, _Node | None]:
        """Segments that no change from ``start`` on can reach, and the others."""
        held = []
        while node is not None:
            node, last = self._last(node)
            held.append(last)
            if (node.chars if node else 0) + LOOK <= start:
                break
        out = None
        for n in reversed(held):
            out = _merged(out, n)
        return node, out

    @staticmethod
    def _last(node: _Node) -> tuple[_Node | None, _Node]:
        tail = node
        while tail.right is not None:
            tail = tail.right
        rest, last = _split(node, node.chars - len(tail.part))
        return rest, last

    @property
    def count(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def text(self) -> str:
        return "".join(n.part for n in _segments(self.root))

    @property
    def segments(self) -> list[tuple[int, int]]:
        return [(len(n.part), n.count) for n in _segments(self.root)]


def _array(trees: list[list[tuple[int, int]]]) -> pa.Array:
    flat = [x for tree in trees for x in tree]
    offsets = [0]
    for tree in trees:
        offsets.append(offsets[-1] + len(tree))
    fields = [pa.array([x[i] for x in flat], pa.int32()) for i in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=["chars", "tokens"]))


def _lists(column: pa.ListArray) -> list[list[tuple] | None]:
    """The structs of each row's list as tuples, without a dict for each of them; null rows stay null."""
    flat = column.flatten()
    rows = list(zip(*(flat.field(i).to_pylist() for i in range(flat.type.num_fields)))) if len(flat) else []
    missing = [not ok for ok in flat.is_valid().to_pylist()] if flat.null_count else []
    if missing:
        rows = [None if gone else r for r, gone in zip(rows, missing)]
    out, at = [], 0
    for n in pc.list_value_length(column).to_pylist():
        out.append(None if n is None else rows[at : at + n])
        at += n or 0
    return out


def _edits(column: pa.ListArray) -> list[list[tuple]]:
    """start, length and replacement of each row's edits, null ones left out."""
    names = [column.type.value_type.field(i).name for i in range(column.type.value_type.num_fields)]
    order = [names.index(n) for n in ("start", "length", "replacement")]
    return [[tuple(e[i] for i in order) for e in edits or [] if e is not None] for edits in _lists(column)]


def with_segments(docs: DataFrame, out: str = "segments", vocabulary: str = "byte_bpe_multi_50k.tiktoken", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``out``, the tree of each text: (chars, tokens) of its segments in order.

    Keep this column with the text and edits need no full encoding again. A null or empty text has no segments. A column that
    is named ``out`` already is replaced. An empty table gives an empty result.
    """
    docs = docs.drop(out)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = codec(*_named(vocabulary))
        trees = [segments_of(tool, tool.split(text or "")) for text in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, _array(trees)], names=[*batch.schema.names, out])

    return docs.mapInArrow(per_batch(run, 256), StructType([*docs.schema.fields, *_kinds(docs.sparkSession, f"`{out}` {SEGMENTS}")]))


def _kinds(spark: SparkSession, ddl: str) -> list:
    return list(StructType.fromDDL(ddl).fields)


def apply_edits(
    trees: DataFrame, edits_col: str = "edits", segments_col: str = "segments", vocabulary: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each input row: id, tokens before and after its edits, characters encoded for them, the edited ``text`` and its ``segments``.

    ``edits_col`` is an array of structs (start, length, replacement), applied in order to the text as it then stands; starts
    count code points from 0 and are held to the text. ``segments_col`` is the column that ``with_segments`` made, or that
    this operator returned; where it is null the text is encoded first. A null text counts as empty; null or no edits leave
    the text; a null start or length counts as 0, a null replacement as empty. Other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = codec(*_named(vocabulary))
        rows: list[tuple] = []
        for text, edits, kept in zip(batch.column(1).to_pylist(), _edits(batch.column(2)), _lists(batch.column(3))):
            tree = TokenTree(text or "", tool, kept=kept)
            before, tree.reencoded = tree.count, 0
            for edit in edits or []:
                start, length, new = edit
                tree.replace(start or 0, length or 0, new or "")
            rows.append((before, tree.count, tree.reencoded, tree.text, tree.segments))
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), _array(list(columns[4]))],
            names=[id_col, "n_tokens_before", "n_tokens_after", "reencoded_chars", "text", "segments"],
        )

    slim = trees.select(F.col(id_col), F.col(text_col), F.col(edits_col), F.col(segments_col))
    kinds = f"n_tokens_before bigint, n_tokens_after bigint, reencoded_chars bigint, text string, segments {SEGMENTS}"
    return slim.mapInArrow(per_batch(run, 256), StructType([slim.schema[0], *_kinds(trees.sparkSession, kinds)]))


def edit_script(text: Column) -> Column:
    """A replacement, a deletion and an insertion at places that depend on the text only, as a test of the counts."""
    text = F.coalesce(text, F.lit(""))
    place = lambda seed: F.pmod(F.xxhash64(F.lit(seed), text), F.char_length(text) + 1).cast("int")
    edit = lambda seed, length, new: F.struct(place(seed).alias("start"), F.lit(length).alias("length"), F.lit(new).alias("replacement"))
    return F.array(edit(1, 5, "amended"), edit(2, 40, ""), edit(3, 0, " added words"))


def op4_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = with_segments(docs.select("doc_id", "text", edit_script(F.col("text")).alias("edits")))
    found = apply_edits(trees)
    return found.select("doc_id", "n_tokens_before", "n_tokens_after", "reencoded_chars", F.size("segments").alias("n_segments"), F.sha2("text", 256).alias("edited_sha256"))

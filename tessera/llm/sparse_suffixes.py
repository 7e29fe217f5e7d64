"""Repeated passages by a sparse suffix array (operator 10).

Of all suffixes of the texts, by words, only those are retained that start at a minimiser: the word five-gram with the least
hash among the five-grams that begin in a stretch of ``STRETCH`` words. The stretch at the start of a passage of ``LEAST`` words
or more picks the same place in every copy, and leaves ``CORE`` = ``LEAST - STRETCH + 1`` words of the passage to its right.

A retained suffix can only take part in a match if its first CORE words begin a suffix of another document too. A first pass
over hashes of these words finds the suffixes for which that holds; only they go on, as text. They are sorted by their words
over sampled ranges, so that suffixes with a common beginning are neighbours, and neighbours are compared word for word. From
the CORE words that a run of neighbours shares, matches are extended to the left and to the right over the passages whose
stretch picks this place; adjoining passages form the spans.

A run may be cut by a border between two ranges, and a common passage makes a run of any length. Of the first and last run of
a range, and of parts of ``RUN`` rows of longer ones, passages that only one document has there are therefore compared by their
digests with those of the other parts; a part sends each of its passages once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import partitions, stored, table

LEAST, GRAM, STRETCH = 50, 5, 20
CORE = LEAST - STRETCH + 1
#: Rows of a run that one task holds as text.
RUN = 16_384
#: Characters of text that are hashed at once.
SLICE_CHARS = 1 << 21


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1, 1 << 63, dtype=np.uint64)) * 2 + 1 & (1 << 64) - 1


def _powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < count."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(count, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_CACHE: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _table(seed: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (count - 1).bit_length())
    if (seed, size) not in _CACHE:
        for key in [k for k in _CACHE if k[0] == seed]:
            del _CACHE[key]
        _CACHE[seed, size] = _powers(_odd(seed), size)
    return _CACHE[seed, size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of several texts, hashed, with the hashes of their runs."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        change = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
        starts, ends = change[::2], change[1::2]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(starts, begins)  # words[bounds[i]:bounds[i + 1]] are those of text i
        self.count = len(starts)
        values = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)[data]
        up, down = _table(2, len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(data)], dtype=np.uint64)))
        self.data, self.starts, self.ends = data, starts, ends
        self.hashes = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        up, _ = _table(3, self.count + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * up[: self.count], dtype=np.uint64)))

    def run(self, at: np.ndarray, length: int) -> np.ndarray:
        """The hash of ``length`` words from each place; places must leave room for them."""
        _, down = _table(3, self.count + 1)
        return _mixed((self.sums[at + length] - self.sums[at]) * down[at])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Each place where LEAST words of one text begin, and the place that its stretch picks."""
        sizes = np.maximum(np.diff(self.bounds) - LEAST + 1, 0)
        total = int(sizes.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.repeat(self.bounds[:-1] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(total)
        grams = self.run(np.arange(self.count - GRAM + 1), GRAM)
        least, place, width = grams, np.arange(len(grams)), 1
        while width < STRETCH:
            shift = min(width, STRETCH - width)
            later = least[shift:] < least[: len(least) - shift]  # the first of equals
            place = np.where(later, place[shift:], place[: len(place) - shift])
            least = np.where(later, least[shift:], least[: len(least) - shift])
            width += shift
        return at, place[at]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts = batch.column(column).cast(pa.binary()).to_pylist()
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text or b"")
            if size >= SLICE_CHARS or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), [t or b"" for t in texts[start : i + 1]]
                start, size = i + 1, 0


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the retained suffixes: key, doc_id, place."""
    for batch, texts in _slices(batches, 1):
        words = Words(texts)
        _, picked = words.anchors()
        picked = np.unique(picked)
        owner = np.searchsorted(words.bounds, picked, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(words.run(picked, CORE).view(np.int64)), batch.column(0).take(pa.array(owner)), pa.array((picked - words.bounds[owner]).astype(np.int32))],
            names=["key", "doc_id", "place"],
        )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, places) to the suffixes at those places: suffix, core (its first bytes that are CORE words), before, doc_id, place.

    ``before`` and ``suffix`` hold, with one space between words, what the passages whose stretch picks the place reach.
    """
    for batch, texts in _slices(batches, 1):
        words = Words(texts)
        at, picked = words.anchors()
        wanted = np.zeros(words.count + 1, bool)
        places = batch.column(2)
        owners = np.repeat(np.arange(len(texts)), np.diff(places.offsets.to_numpy()))
        flat = words.bounds[owners] + places.flatten().to_numpy(zero_copy_only=False)
        wanted[flat[flat < words.bounds[owners + 1]]] = True
        at, picked = at[wanted[picked]], picked[wanted[picked]]
        # The passages of one place begin at neighbouring words.
        first = np.flatnonzero(np.concatenate(([True], picked[1:] != picked[:-1]))) if len(picked) else np.zeros(0, np.int64)
        low, place = at[first], picked[first]
        high = at[np.concatenate((first[1:] - 1, [len(at) - 1]))] + LEAST if len(first) else low
        owner = np.searchsorted(words.bounds, place, side="right") - 1
        # All words of the slice with one space between them.
        data, starts, ends = words.data, words.starts, words.ends
        size = ends - starts + 1
        line = np.cumsum(np.concatenate(([0], size)))
        flat_text = bytes(_spaced(data, starts, ends, line))
        cut = lambda a, b: [flat_text[x:y] for x, y in zip(line[a].tolist(), (line[b] - 1).tolist())]
        core = line[np.minimum(place + CORE, words.count)] - 1 - line[place]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(cut(place, high), pa.binary()), pa.array(core.astype(np.int32)), pa.array([x[:-1] if x else x for x in _before(flat_text, line, low, place)], pa.binary()),
                batch.column(0).take(pa.array(owner)), pa.array((place - words.bounds[owner]).astype(np.int32)),
            ],
            names=["suffix", "core", "before", "doc_id", "place"],
        )


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, line: np.ndarray) -> np.ndarray:
    out = np.full(int(line[-1]), 32, np.uint8)
    shift = np.repeat(starts - line[:-1], ends - starts)
    places = np.arange(len(shift)) + np.repeat(line[:-1] - np.concatenate(([0], np.cumsum(ends - starts)[:-1])), ends - starts) if len(shift) else shift
    out[places] = data[places + shift]
    return out


def _before(text: bytes, line: np.ndarray, low: np.ndarray, place: np.ndarray) -> list[bytes]:
    return [text[a:b] for a, b in zip(line[low].tolist(), line[place].tolist())]


def passages(before: bytes, suffix: bytes) -> list[bytes]:
    """All passages of LEAST words within a suffix and what stands before it, in order of their starts."""
    whole = before + b" " + suffix if before else suffix
    ends = list(accumulate([len(w) + 1 for w in whole.split(b" ")], initial=0))
    return [whole[a : b - 1] for a, b in zip(ends, ends[LEAST:])]


class Run:
    """Neighbouring suffixes that share their first CORE words: each context once, with its documents."""

    def __init__(self, core: bytes) -> None:
        self.core = core
        self.contexts: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        self.rows = 0

    def add(self, before: bytes, suffix: bytes, doc: int, place: int) -> None:
        self.contexts.setdefault((before, suffix), []).append((doc, place))
        self.rows += 1

    def matches(self, whole: bool) -> Iterator[tuple]:
        """(doc, first start, last start, None, None) of neighbouring passages that another document's suffix of the run has too.

        Unless the run is whole, also what must be compared elsewhere: (least doc, None, None, digest, largest doc) of passages
        that several documents have here, and (doc, start, start, digest, doc) of the others.
        """
        owners: dict[bytes, tuple[int, int]] = {}
        for (before, suffix), rows in self.contexts.items():
            low, high = min(rows)[0], max(rows)[0]
            for p in passages(before, suffix):
                a, b = owners.get(p, (low, high))
                owners[p] = min(a, low), max(b, high)
        for (before, suffix), rows in self.contexts.items():
            left = before.count(b" ") + 1 if before else 0
            open_ = None
            every = passages(before, suffix)
            found = [owners[p][0] != owners[p][1] for p in every]
            for i, hit in enumerate([*found, False]):
                if hit and open_ is None:
                    open_ = i
                elif not hit and open_ is not None:
                    yield from ((d, place - left + open_, place - left + i - 1, None, None) for d, place in rows)
                    open_ = None
            if not whole:
                for i, p in enumerate(every):
                    if not found[i]:
                        key = blake2b(p, digest_size=16).digest()
                        yield from ((d, place - left + i, place - left + i, key, d) for d, place in rows)
        if not whole:
            for p, (low, high) in owners.items():
                if low != high:
                    yield low, None, None, blake2b(p, digest_size=16).digest(), high


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 50_000)):
        doc, first, last, key, high = zip(*part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(key, pa.binary()), pa.array(high, pa.int64())],
            names=["doc_id", "first", "last", "key", "high"],
        )


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in suffix order to ``Run.matches``; the first and last run of a partition, and long ones, are not whole."""

    def rows() -> Iterator[tuple]:
        run, whole = None, False
        for batch in batches:
            for suffix, core, before, doc, place in zip(*(c.to_pylist() for c in batch.columns)):
                start = suffix[:core]
                if run is None or start != run.core:
                    if run is not None:
                        yield from run.matches(whole)
                    run, whole = Run(start), run is not None
                run.add(before, suffix, doc, place)
                if run.rows >= RUN:
                    yield from run.matches(False)
                    run, whole = Run(start), False
        if run is not None:
            yield from run.matches(False)

    return _batches(rows())


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their keys, then doc_id (the last column but one), those in a run of equal keys with two ids: ``sure``.

    Works on one batch at a time. The first and last run of a batch may go on in another: their rows are returned too, with
    their keys; other rows no longer need theirs.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-2]], axis=1)
        ids = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
        low = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1))
        high = np.concatenate((low[1:], [len(ids)]))
        sure = ids[low] != ids[high - 1]
        end = np.zeros(len(low), bool)
        end[[0, -1]] = True
        size = high - low
        inner = pa.array(np.repeat(~end, size))
        columns = [pc.if_else(inner, None, c) for c in batch.columns[:-2]]
        out = pa.RecordBatch.from_arrays([*columns, *batch.columns[-2:], pa.array(np.repeat(sure, size))], names=[*batch.schema.names, "sure"])
        yield out.filter(pa.array(np.repeat(end | sure, size)))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id and place of the rows whose keys another doc_id has too, by sorting and comparing neighbours."""
    n = partitions(rows.sparkSession)
    order = [*keys, "doc_id", "place"]
    dealt = rows.select(*order).repartitionByRange(n, *keys, "doc_id").sortWithinPartitions(*order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    found = stored(dealt.mapInArrow(_neighbours, f"{kinds}, sure boolean"))
    # Runs at the ends of batches, put together again: a row that is not sure may have its neighbour in another batch.
    ends = found.where(F.col(keys[0]).isNotNull())
    ends = ends.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select(*keys)
    unsure = found.where("NOT sure").join(ends, keys, "left_semi")
    return found.where("sure").select("doc_id", "place").union(unsure.select("doc_id", "place"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive) and n_words of every span that passages of LEAST words or more cover which occur in another document too.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte over whole texts. Documents without such a passage, with null or
    short texts, or with a null id have no row. Rows with one id count as one document, so a repeated row alone is no repeat.
    Spans of a document that touch or overlap are one. Other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    suffixes = texts.mapInArrow(_suffixes, "key bigint, doc_id bigint, place int")
    places = repeated(suffixes, ["key"]).groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("places"))
    kept = texts.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(_contexts, "suffix binary, core int, before binary, doc_id bigint, place int")
    # The range key is bounded, whatever the words: the core and a hash of the rest, so that a common core is cut into ranges too.
    beginning = F.expr("substring(suffix, 1, core)")
    ordered = kept.repartitionByRange(partitions(docs.sparkSession), beginning, F.xxhash64("suffix", "before", "doc_id")).sortWithinPartitions("suffix", "before", "doc_id")
    found = stored(ordered.mapInArrow(_extended, "doc_id bigint, first int, last int, key binary, high bigint"))
    keyed = found.where("key IS NOT NULL")
    keys = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("high").alias("top")).where("low <> top").select("key")
    unsure = keyed.where("first IS NOT NULL").join(keys, "key", "left_semi")
    matches = found.where("key IS NULL").select("doc_id", "first", "last").union(unsure.select("doc_id", "first", "last"))
    line = Window.partitionBy("doc_id").orderBy("first", "last")
    reach = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1)) + LEAST
    opens = F.coalesce((F.col("first") > reach).cast("int"), F.lit(1))
    spans = matches.distinct().withColumn("opens", opens).withColumn("span", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = spans.groupBy("doc_id", "span").agg(F.min("first").alias("start_word"), (F.max("last") + LEAST).alias("end_word"))
    return out.select("doc_id", F.col("start_word").cast("long"), F.col("end_word").cast("long"), (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"))


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), p AS (
  SELECT doc_id, place, md5(array_to_string(ws[place + 1 : place + {LEAST}], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {LEAST - 1})) AS place FROM w WHERE len(ws) >= {LEAST})
), r AS (SELECT k FROM p GROUP BY k HAVING min(doc_id) <> max(doc_id)),
q AS (SELECT DISTINCT doc_id, place FROM p WHERE k IN (SELECT k FROM r)),
o AS (SELECT *, CASE WHEN place > lag(place) OVER l + {LEAST} OR lag(place) OVER l IS NULL THEN 1 ELSE 0 END AS opens FROM q WINDOW l AS (PARTITION BY doc_id ORDER BY place)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM o)
SELECT doc_id, min(place) AS start_word, max(place) + {LEAST} AS end_word, max(place) + {LEAST} - min(place) AS n_words
FROM s GROUP BY doc_id, span
"""

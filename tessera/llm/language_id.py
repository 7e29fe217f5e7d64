"""Language identification by cross-parsing entropy (operator 3).

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed against it from left to
right into the longest phrases that occur in the sample; the language that needs the fewest phrases for each character,
weighted by the bits that name a place in its sample, wins. A greedy parse reads each character once and only needs to know
whether the automaton can go on. All transitions of all languages therefore lie in one array, each state's as a small hash
table without collisions, so the array grows with the transitions, not with the alphabet. Every letter of a sample has a
code of its own, whatever the script.

numpy walks many texts through all languages in step, in blocks of ``BLOCK`` characters that all begin with a new phrase. Then
each block is walked again from the state in which the block before it ends, until the states agree, which they do after a
phrase or two; so phrases run over the borders between blocks, and the counts are those of one parse of the whole text.
Only letters speak for a language: case is folded, and each run of other characters counts as one space.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import per_batch, table

#: Bounds of what is learned: characters and documents for each language, both less if there are many languages (the totals),
#: and languages, the most frequent ones.
SAMPLE_CHARS, SAMPLE_DOCS = 40_000, 64
TOTAL_CHARS, TOTAL_DOCS, LANGUAGES = 4_000_000, 4096, 256
#: Characters of one passage of a drawn document, and passages of a document, spread over its whole length.
PASSAGE, PASSAGES = 1000, 5
BLOCK = 1024
#: Cells (characters times languages) that a worker parses at once.
CELLS = 4_000_000
#: Bits of a row's hash, and the multipliers that are tried for it.
HASHED = 20
MASK = (1 << HASHED) - 1
MULTIPLIERS = tuple(2 * int(x) + 1 for x in np.random.default_rng(7).integers(1 << 10, 1 << 19, 12))
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: whether it is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start. A code 0 breaks the sequence."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        if c == 0:
            last = 0
            continue
        p = last
        if c in nexts[p] and length[nexts[p][c]] == length[p] + 1:
            last = nexts[p][c]
            continue
        new = -1
        if c not in nexts[p]:
            new = len(nexts)
            nexts.append({})
            length.append(length[p] + 1)
            link.append(0)
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p == -1:
                last = new
                continue
        q = nexts[p][c]
        if length[p] + 1 == length[q]:
            target = q
        else:
            target = len(nexts)
            nexts.append(dict(nexts[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = target
            while p != -1 and nexts[p].get(c) == q:
                nexts[p][c] = target
                p = link[p]
        if new == -1:
            last = target
        else:
            link[new] = target
            last = new
    return nexts


def packed(rows: list[dict[int, int]], width: int) -> tuple[list[int], list[int], list[int]]:
    """The rows of an automaton, one behind the other, each a small hash table without collisions.

    Returns a descriptor of each row (its start, a multiplier and the logarithm of its length), and by place the code it
    holds (0: none) and the row that follows. A row is at most as long as a dense one.
    """
    dense = max(1, (width - 1).bit_length())
    described, held, at = [], [], 0
    for row in rows:
        n = len(row)
        k, m = (0 if n <= 1 else (n - 1).bit_length()), 1
        while k:
            if k >= dense:
                k, m = dense, 1 << HASHED - dense
                break
            m = next((m for m in MULTIPLIERS if len({(c * m & MASK) >> HASHED - k for c in row}) == n), 0)
            if m:
                break
            k += 1
        described.append(at << 26 | m << 5 | k)
        held.append((at, m, k))
        at += 1 << k
    codes, follow = [0] * at, [0] * at
    for (start, m, k), row in zip(held, rows):
        for c, state in row.items():
            place = start + ((c * m & MASK) >> HASHED - k)
            codes[place], follow[place] = c, described[state]
    return described, codes, follow


class CrossParser:
    """The tables of all languages. ``samples`` maps a language to its sample texts."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.langs = sorted(samples)
        lower = {k: [t.lower() for t in v] for k, v in samples.items()}
        letters = _letters()
        chosen = sorted({c for texts in lower.values() for text in texts for c in text if letters[ord(c)]})
        # 0: a letter that no sample has; 1: other characters; above: a letter.
        self.classes = np.where(letters, 0, 1).astype(np.int32)
        for i, c in enumerate(chosen):
            self.classes[ord(c)] = i + 2
        width = self.width = len(chosen) + 2
        if width > MASK:
            raise ValueError("more letters than a row's hash tells apart")
        code_at, row_at, bits, at = [], [], [], 0
        self.first = np.zeros((len(self.langs), width), np.int64)
        self.starts = np.zeros(len(self.langs), np.int64)
        for k, lang in enumerate(self.langs):
            codes = [c for t in lower[lang] for c in (*self.codes(t).tolist(), 0)]
            nexts = suffix_automaton(codes)
            root, nexts[0] = nexts[0], {}
            described, held, follow = packed(nexts, width)
            self.starts[k] = described[0] + (at << 26)
            self.first[k] = self.starts[k]  # after a miss a new phrase begins with the missed character
            for c, state in root.items():
                self.first[k, c] = described[state] + (at << 26)
            code_at.append(np.array(held, np.int32))
            row_at.append(np.array(follow, np.int64) + (at << 26))
            bits.append(log2(max(2, len(codes))))
            at += len(held)
        self.code_at = np.concatenate(code_at) if code_at else np.zeros(0, np.int32)
        self.row_at = np.concatenate(row_at) if row_at else np.zeros(0, np.int64)
        self.bits = np.array(bits)

    def codes(self, text: str) -> np.ndarray:
        """0 for a letter of no sample, 1 for a run of other characters, above that a letter."""
        found = self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return found[np.concatenate(([True], (found[1:] != 1) | (found[:-1] != 1)))] if len(found) else found

    def _step(self, state: np.ndarray, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a new phrase begins."""
        place = (state >> 26) + ((codes * (state >> 5 & 0x1FFFFF) & MASK) >> HASHED - (state & 31))
        new = (self.code_at[place] != codes) | (codes == 0)
        return np.where(new, first, self.row_at[place]), new

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language, as an array (texts, languages)."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not self.langs:
            return out
        most = max(1, CELLS // (BLOCK * len(self.langs)))
        held: list[tuple[int, np.ndarray]] = []
        for i, text in enumerate(texts):
            codes = self.codes(text.lower())
            blocks = [(i, codes[at : at + BLOCK]) for at in range(0, len(codes), BLOCK)]
            if held and len(held) + len(blocks) > most:
                self._count(held, out)
                held = []
            state = None
            while len(blocks) > most:  # of a very long text some blocks at a time
                state = self._count(blocks[:most], out, state)
                blocks = blocks[most:]
            if state is not None:
                self._count(blocks, out, state)
            else:
                held += blocks
        self._count(held, out)
        return out

    def _count(self, held: list[tuple[int, np.ndarray]], out: np.ndarray, entry: np.ndarray | None = None) -> np.ndarray | None:
        """Adds the phrases of texts, given as all their blocks in order; the first block begins in the states ``entry``.

        Returns the states in which the last block ends.
        """
        if not held:
            return entry
        owner = np.array([i for i, _ in held])
        blocks = [b for _, b in held]
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        longest, langs = int(sizes.max()), len(self.langs)
        grid = np.zeros((longest, len(blocks)), np.int64)
        place = np.empty(len(blocks), np.int64)  # the column of each block
        place[order] = np.arange(len(blocks))
        for b, column in zip(blocks, place):
            grid[: len(b), column] = b
        active = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")
        state = np.repeat(self.starts[:, None], len(blocks), axis=1)
        if entry is not None:
            state[:, place[0]] = entry
        trace = np.zeros((longest, langs, len(blocks)), np.int64)  # state and whether a phrase began, by character
        count = np.zeros((langs, len(blocks)), np.int64)
        for t, n in enumerate(active):
            state[:, :n], new = self._step(state[:, :n], grid[t, :n], self.first[:, grid[t, :n]])
            trace[t, :, :n] = state[:, :n] << 1 | new
            count[:, :n] += new
        # Each block after the first of its text goes on from the end of the one before it.
        behind = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        ends, counts = state[:, place].copy(), count[:, place].copy()  # by block, in order
        entered = np.full((langs, len(blocks)), -1, np.int64)
        lang, block = (x.reshape(-1) for x in np.meshgrid(np.arange(langs), behind, indexing="ij"))
        while len(block):
            entered[lang, block] = ends[lang, block - 1]
            more, last = self._walk(grid, trace, lang, place[block], entered[lang, block], sizes[block])
            counts[lang, block] = count[lang, place[block]] + more
            ends[lang, block] = last
            # A block whose predecessor's end turned out to be another one is walked again.
            lang, block = np.nonzero(entered[:, behind] != ends[:, behind - 1])
            block = behind[block]
        np.add.at(out, owner, counts.T)
        return ends[:, -1]

    def _walk(self, grid: np.ndarray, trace: np.ndarray, lang: np.ndarray, column: np.ndarray, state: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases more than by the trace begin in each block from ``state`` on, and the states at its end."""
        more = np.zeros(len(lang), np.int64)
        last = trace[size - 1, lang, column] >> 1
        todo = np.arange(len(lang))
        t = 0
        while len(todo):
            codes = grid[t, column[todo]]
            state, new = self._step(state, codes, self.first[lang[todo], codes])
            was = trace[t, lang[todo], column[todo]]
            more[todo] += new.astype(np.int64) - (was & 1)
            t += 1
            done = state == was >> 1
            over = ~done & (size[todo] == t)
            last[todo[over]] = state[over]
            todo, state = todo[~done & ~over], state[~done & ~over]
        return more, last

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the language and a score from 0 (a tie) to 1; ``und`` and 0 for null or no letter."""
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.langs or not known:
            return out
        cost = self.phrases([texts[i] for i in known]) * self.bits
        best = cost.argmin(axis=1)
        for i, row, b in zip(known, cost, best):
            second = np.delete(row, b).min() if len(row) > 1 else 0.0
            out[i] = (self.langs[b], float(1 - row[b] / second) if second > 0 else float(len(row) == 1))
        return out


def samples(docs: DataFrame, chars: int = SAMPLE_CHARS, count: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """For each language of ``docs`` (columns text, lang) passages of its distinct documents with the lowest text hashes.

    At most LANGUAGES languages are learned, the ones with most rows; a language gives ``count`` documents and about ``chars``
    characters, less by an even share of the totals if there are many. A document that is longer than its PASSAGES passages
    gives that many, spread over its whole length, so a long one teaches no less than a short one. Copies count once: the hash
    decides, and the share drawn follows a sketch of distinct hashes. An empty table gives an empty result.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("lang", "text", F.xxhash64(F.lit(3), "text").alias("h"))
    rows = rows.withColumn("u", F.pmod(F.col("h"), F.lit(1 << 52)) / F.lit(float(1 << 52)))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h", 0.05).alias("d"))
    learned = sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not learned:
        return {}
    count, chars = min(count, TOTAL_DOCS // len(learned)), min(chars, TOTAL_CHARS // len(learned))
    # Twice as many as wanted, for the sketch's error; the lowest hashes of them are the lowest of all.
    limit = F.lit(-1.0)
    for r in learned:
        limit = F.when(F.col("lang") == r["lang"], F.lit(min(1.1, 2 * count / r["d"]))).otherwise(limit)
    n = F.char_length("text")
    whole = n <= PASSAGE * PASSAGES
    step = ((n - PASSAGE) / F.lit(PASSAGES - 1)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda i: F.substring("text", i * step + 1, F.lit(PASSAGE)))
    drawn = rows.where(F.col("u") < limit).select("lang", "u", F.when(whole, F.array("text")).otherwise(spread).alias("passages")).distinct()
    out: dict[str, list[str]] = {}
    for lang, group in groupby(sorted(drawn.collect(), key=lambda r: (r["lang"], r["u"], r["passages"])), key=lambda r: r["lang"]):
        held = out.setdefault(lang, [])
        size = 0
        for r in list(group)[:count]:
            if size >= chars:
                break
            held += r["passages"]
            size += sum(map(len, r["passages"]))
    return out


@lru_cache(maxsize=2)
def _parser(key: tuple[tuple[str, tuple[str, ...]], ...]) -> CrossParser:
    return CrossParser({k: list(v) for k, v in key})


def identify(docs: DataFrame, learned: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: its id, ``lang_pred`` and ``score``. Only the text is an input of the prediction.

    Null texts and texts without a letter get ``und`` and 0. Ties go to the first language by code point. Texts are parsed whole.
    The samples go to the executors by broadcast, bounded by their parameters; each worker builds the tables once. Repeated
    rows give repeated rows, an empty table an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tuple((k, tuple(v)) for k, v in sorted(learned.items())))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _parser(sent.value).predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[id_col, "lang_pred", "score"]
        )

    slim = docs.select(F.col(id_col), F.col(text_col))
    return slim.mapInArrow(per_batch(run, 1024), f"`{id_col}` {slim.schema[0].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = samples(docs.where(~held_out("doc_id", 4, 2)))
    return identify(docs, learned).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")

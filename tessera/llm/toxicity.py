"""Toxicity scores by Levenshtein automata over a lexicon trie (operator 6).

The lexicon (whole words and word stems) is learned from labelled texts: terms that mark toxic documents and hardly occur in
others. A product automaton of the lexicon's trie with the Levenshtein automaton of each term, made deterministic as words
ask for its states, reads each word of a text once and gives the fewest edits that turn it into a term. A window around each
hit tells quotation from abuse, by quotation marks and by the words that stand there; a logistic regression over counts of
hits by kind and the tone of their windows, fitted on the same rows, gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tessera.llm.common import per_batch, table, unit_hash
from tessera.llm.language_id import held_out

#: Labelled documents of each class that the lexicon and the weights are fitted on, drawn by a hash of the id, and the longest
#: text that is fitted on; both bound what the driver holds. Every text is scored, whatever its length.
SAMPLE, LONGEST = 1500, 1 << 20
#: A term is in this share of the toxic sample at least, and so many times as dense there as in the rest: the purity is chosen
#: among these by cross-validation over FOLDS parts of the sample.
SUPPORT, RATIOS, FOLDS = 0.008, (8, 15, 30, 60), 3
#: From this many hits among a hundred words on, a document counts in full.
DENSE = 1.0
FEATURES = 9
#: A stem has so many letters at least; a whole word may have any number. Edits are allowed from these lengths on.
LEAST_STEM, LEAST_FUZZY_WORD, LEAST_FUZZY_STEM = 4, 5, 6
WINDOW = 60
#: Windows that a word's share among the windows of toxic and of other documents is drawn towards its share in all by.
PRIOR = 20.0
#: Documents whose words are counted at once, which bounds the driver's memory.
PART = 128
#: Words whose kind a worker remembers.
KNOWN = 1 << 16
#: Scripts that put no space between words: there each two neighbouring characters are a word.
_SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U000323af"
_WORD, _ANY_SPACELESS, _RUN = re.compile(r"\w+"), re.compile(f"[{_SPACELESS}]"), re.compile(rf"[{_SPACELESS}]+|[^\W{_SPACELESS}]+")
_OPEN, _CLOSE = "\"\u201c\u201e\u00ab\u2039", "\"\u201d\u201c\u00bb\u203a"
NONE, FUZZY, EXACT = 0, 1, 2


def spans(text: str) -> list[tuple[str, int, int]]:
    """The words of a text in lower case and their places."""
    if not _ANY_SPACELESS.search(text):
        return [(m[0], *m.span()) for m in _WORD.finditer(text)]
    out = []
    for m in _RUN.finditer(text):
        start, end = m.span()
        if end - start > 2 and _ANY_SPACELESS.match(text, start):
            out += [(text[i : i + 2], i, i + 2) for i in range(start, end - 1)]
        else:
            out.append((m[0], start, end))
    return out


def words(text: str) -> list[str]:
    return [w for w, _, _ in spans(text)] if _ANY_SPACELESS.search(text) else _WORD.findall(text)


class Automaton:
    """The deterministic product of a trie of terms (a trailing ``*`` makes a stem) and Levenshtein automata."""

    def __init__(self, terms: list[str], edits: int) -> None:
        self.edits = edits
        self.children: list[dict[str, int]] = [{}]
        self.word, self.stem = {}, {}
        for term in sorted(terms):
            node = 0
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            (self.stem if term.endswith("*") else self.word)[node] = True
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.hits: list[int] = []
        self.start = self._state({(0, 0)}) if terms else -1

    def _state(self, places: set[tuple[int, int]]) -> int:
        """The number of a state; -1 when no term can be reached. Skipped letters of a term are followed here."""
        least: dict[int, int] = {}
        todo = list(places)
        while todo:
            node, cost = todo.pop()
            if cost > self.edits or least.get(node, self.edits + 1) <= cost:
                continue
            least[node] = cost
            todo += [(child, cost + 1) for child in self.children[node].values()]
        if not least:
            return -1
        key = frozenset(least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.ends.append(min((c for n, c in key if n in self.word or n in self.stem), default=-1))
            self.hits.append(min((c for n, c in key if n in self.stem), default=-1))
        return self.ids[key]

    def _move(self, state: int, letter: str) -> int:
        places = set()
        for node, cost in self.sets[state]:
            places.add((node, cost + 1))
            for c, child in self.children[node].items():
                places.add((child, cost + (c != letter)))
        found = self.moves[state][letter] = self._state(places)
        return found

    def least_edits(self, word: str) -> int:
        """The fewest edits (at most ``edits``) from the word, or from one of its beginnings for a stem, to a term; else -1."""
        state, best = self.start, -1
        for letter in word:
            if state < 0:
                return best
            if (hit := self.hits[state]) >= 0 and (best < 0 or hit < best):
                best = hit
            found = self.moves[state].get(letter)
            state = self._move(state, letter) if found is None else found
        if state >= 0 and (end := self.ends[state]) >= 0 and (best < 0 or end < best):
            best = end
        return best


def density(hits: float, words: int) -> float:
    """Hits among a hundred words, at most DENSE."""
    return min(DENSE, 100 * hits / max(1, words))


class Vocabulary:
    """The distinct words of labelled documents in order, the beginnings that they share, and how dense each is in each document.

    Beginnings are the branches of a trie: the longest one that all words below a branch have in common stands for all shorter
    ones with the same words. So there are fewer of them than words, however long these are. ``entries`` are words, then branches.
    """

    def __init__(self, documents: list[Counter]) -> None:
        self.words = sorted(set().union(*documents))
        number = {w: i for i, w in enumerate(self.words)}
        self.parent = np.full(len(self.words), -1, np.int64)
        self.text, self.low, self.high = list(self.words), list(range(len(self.words))), list(range(1, len(self.words) + 1))
        self._branches()
        self.totals = np.array([d.total() for d in documents], np.int64)
        doc, word, count, at, entry, mass = [], [], [], [], [], []
        for start in range(0, len(documents), PART):
            part = documents[start : start + PART]
            d = np.repeat(np.arange(start, start + len(part), dtype=np.int32), [len(x) for x in part])
            w = np.fromiter((number[x] for words_ in part for x in words_), np.int32, len(d))
            n = np.fromiter((k for words_ in part for k in words_.values()), np.int32, len(d))
            doc.append(d)
            word.append(w)
            count.append(n)
            places, hits = self._by_entry(d, w, n)
            at.append((places // len(self.text)).astype(np.int32))
            entry.append((places % len(self.text)).astype(np.int32))
            mass.append(np.minimum(DENSE, 100 * hits / np.maximum(1, self.totals[at[-1]])).astype(np.float64))
        join = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)])
        self.doc, self.word, self.n = join(doc, np.int32), join(word, np.int32), join(count, np.int32)
        self.at, self.entry, self.mass = join(at, np.int32), join(entry, np.int32), join(mass, np.float64)

    def _by_entry(self, doc: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and entry in one number, for each word and all branches above it, and how often the document has it."""
        at, keys, sums = doc.astype(np.int64), [doc * np.int64(len(self.text)) + word], [n]
        up = self.parent[word]
        while (below := up >= 0).any():
            at, up, n = at[below], up[below], n[below]
            keys.append(at * len(self.text) + up)
            sums.append(n)
            up = self.parent[up]
        keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, np.bincount(place, np.concatenate(sums), len(keys))

    def _branches(self) -> None:
        """Adds an entry for each branch of LEAST_STEM letters or more, from neighbours' common beginnings."""
        parents: dict[int, int] = {}
        path: list[tuple[int, int]] = []  # (length, entry) of the open branches
        common = 0
        for i, word in enumerate(self.words):
            after = self.words[i + 1] if i + 1 < len(self.words) else ""
            ahead = len(commonprefix((word, after)))
            # The branch that holds this word is the longer one of those with its neighbours.
            if ahead >= LEAST_STEM and (not path or ahead > path[-1][0]):
                parents[len(self.text)] = path[-1][1] if path else -1
                path.append((ahead, len(self.text)))
                self.text.append(word[:ahead])
                self.low.append(i)
                self.high.append(i + 1)
            self.parent[i] = path[-1][1] if path and max(common, ahead) >= LEAST_STEM else -1
            while path and path[-1][0] > ahead:
                length, entry = path.pop()
                self.high[entry] = i + 1
                if ahead >= LEAST_STEM and (not path or path[-1][0] < ahead):
                    # A shorter branch begins where this one does.
                    new = len(self.text)
                    parents[new] = path[-1][1] if path else -1
                    parents[entry] = new
                    self.text.append(word[:ahead])
                    self.low.append(self.low[entry])
                    self.high.append(i + 1)
                    path.append((ahead, new))
                    break
            common = ahead
        self.parent = np.concatenate((self.parent, [parents[e] for e in range(len(self.words), len(self.text))])).astype(np.int64)

    def sums(self, part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By part and entry the documents that hold it and its density in them, and the documents of each part."""
        key = part[self.at] * np.int64(len(self.text)) + self.entry
        size = parts * len(self.text)
        shape = (parts, len(self.text))
        return np.bincount(key, minlength=size).reshape(shape), np.bincount(key, self.mass, size).reshape(shape), np.bincount(part, minlength=parts)

    def hits(self, terms: list[str], entries: list[int]) -> np.ndarray:
        """How often each document holds a word of the terms, whose entries these are."""
        held = np.zeros(len(self.words), bool)
        for term, e in zip(terms, entries):
            held[self.low[e] : self.high[e] if term.endswith("*") else self.low[e] + 1] = True
        return np.bincount(self.doc, self.n * held[self.word], len(self.totals))

    def learn(self, found: np.ndarray, mass: np.ndarray, other: np.ndarray, toxic: int, rest: int, ratio: float) -> tuple[list[str], list[int]]:
        """Words, and stems with a trailing ``*``, that mark the toxic documents by their density there, and their entries.

        The shortest pure beginning is taken, drawn out while nearly all its words share more.
        """
        least = max(4, SUPPORT * toxic)
        pure = (found >= least) & (mass / max(1, toxic) >= ratio * (other + 0.5) / max(1, rest))
        below: dict[int, list[int]] = {}
        for e in np.flatnonzero(found >= least).tolist():
            below.setdefault(int(self.parent[e]), []).append(e)
        terms: dict[str, int] = {}
        todo = below.get(-1, [])[:]
        branch = len(self.words)
        while todo:
            e = todo.pop()
            if not pure[e]:
                todo += below.get(e, [])
                continue
            while (longer := max(below.get(e, []), key=lambda x: (found[x], x), default=None)) is not None and found[longer] >= 0.95 * found[e]:
                e = longer
            terms[self.text[e] + ("*" if e >= branch else "")] = e
        out = sorted(terms)
        return out, [terms[t] for t in out]


class Scorer:
    """``cues`` are words that stand around hits in toxic documents more often (above 0) or less often than in others."""

    def __init__(self, terms: list[str], common: frozenset[str] = frozenset(), weights: tuple[float, ...] = (), cues: dict[str, float] | None = None) -> None:
        self.terms, self.common, self.cues = tuple(terms), common, cues or {}
        self.exact = Automaton(terms, 0)
        self.fuzzy = Automaton([t for t in terms if len(t) >= (LEAST_FUZZY_STEM + 1 if t.endswith("*") else LEAST_FUZZY_WORD)], 1)
        self.weights = np.array(weights)
        self.known: dict[str, int] = {}

    def kind(self, word: str) -> int:
        if (found := self.known.get(word)) is None:
            found = EXACT if self.exact.least_edits(word) == 0 else FUZZY if word not in self.common and self.fuzzy.least_edits(word) >= 0 else NONE
            if len(self.known) >= KNOWN:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = found
        return found

    @staticmethod
    def quoted(text: str, start: int, end: int) -> bool:
        """Whether quotation marks open before and close after the hit, in its window and line."""
        before = text[max(0, start - WINDOW) : start].rpartition("\n")[2]
        after = text[end : end + WINDOW].partition("\n")[0]
        opens = max(map(before.rfind, _OPEN))
        return opens >= 0 and any(c in after for c in _CLOSE) and before.count('"') % 2 == (before[opens] == '"')

    @staticmethod
    def around(text: str, start: int, end: int) -> list[str]:
        """The words in the window of a hit."""
        return words(text[max(0, start - WINDOW) : start]) + words(text[end : end + WINDOW])

    def hits(self, text: str) -> tuple[list[tuple[int, int, int]], int, int]:
        """(kind, start, end) of each hit in a text in lower case, its words and distinct words."""
        distinct = set(words(text))
        kinds = {w: k for w in distinct if (k := self.kind(w))}
        if not kinds:
            return [], 0, len(distinct)
        every = spans(text)
        return [(kinds[w], a, b) for w, a, b in every if w in kinds], len(every), len(distinct)

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        found, total, distinct = self.hits(text)
        exact = fuzzy = quoted = 0
        context = 0.0
        for kind, start, end in found:
            near = self.around(text, start, end) if self.cues else ()
            context += sum(self.cues.get(w, 0.0) for w in near) / max(1, len(near))
            if self.quoted(text, start, end):
                quoted += 1
            elif kind == EXACT:
                exact += 1
            else:
                fuzzy += 1
        tone = max(-1.0, min(1.0, context / max(1, len(found))))
        return [1.0, float(exact > 0), np.log1p(exact), float(fuzzy > 0), np.log1p(fuzzy), np.log1p(quoted), np.log1p(distinct) / 10, density(exact, total), tone]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text), self.weights), -30, 30))))


def learn_cues(scorer: Scorer, texts: list[str], marks: np.ndarray) -> dict[str, float]:
    """For words around hits, how much likelier they are there in toxic documents than in others, as the logarithm of a ratio.

    Both shares are drawn towards the word's share in all windows, so without hits in one class every cue is near 0.
    """
    seen = Counter(), Counter()
    windows = [0, 0]
    for text, mark in zip(texts, marks):
        text = text.lower()
        for _, start, end in scorer.hits(text)[0]:
            windows[mark] += 1
            seen[mark].update(set(scorer.around(text, start, end)))
    out = {}
    for w in seen[0].keys() | seen[1].keys():
        both = seen[0][w] + seen[1][w]
        share = both / (windows[0] + windows[1])
        ratio = [(seen[k][w] + PRIOR * share) / (windows[k] + PRIOR) for k in (0, 1)]
        if both >= 5:
            out[w] = float(np.log(ratio[1] / ratio[0]))
    return out


def regression(features: np.ndarray, labels: np.ndarray, class_weights: tuple[float, float], rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps with a small ridge."""
    w = np.zeros(features.shape[1])
    weight = np.where(labels == 1, class_weights[1], class_weights[0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (weight * (p - labels)) + 0.1 * w
        curve = (features * (weight * p * (1 - p))[:, None]).T @ features + 0.1 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def folds(marks: np.ndarray) -> np.ndarray:
    """The part of each document; both classes are dealt evenly."""
    part = np.zeros(len(marks), np.int64)
    for k in (0, 1):
        part[marks == k] = np.arange((marks == k).sum()) % FOLDS
    return part


def best_ratio(vocabulary: Vocabulary, marks: np.ndarray, class_weights: tuple[float, float]) -> float:
    """The purity whose terms, learned without a part of the sample, tell that part's classes best by a regression over exact
    hits; the highest of equals."""
    wrong = dict.fromkeys(RATIOS, 0.0)
    part = folds(marks)
    found, mass, sizes = vocabulary.sums(part * 2 + marks, 2 * FOLDS)
    distinct = np.bincount(vocabulary.doc, minlength=len(marks))
    for fold in range(FOLDS):
        kept = np.flatnonzero(part != fold)
        others = [f for f in range(FOLDS) if f != fold]
        toxic, rest = [2 * f + 1 for f in others], [2 * f for f in others]
        for ratio in RATIOS:
            terms = vocabulary.learn(found[toxic].sum(0), mass[toxic].sum(0), mass[rest].sum(0), sizes[toxic].sum(), sizes[rest].sum(), ratio)
            hits = vocabulary.hits(*terms)
            dense = np.minimum(DENSE, 100 * hits / np.maximum(1, vocabulary.totals))
            features = np.stack([np.ones(len(hits)), hits > 0, np.log1p(hits), np.log1p(distinct) / 10, dense], axis=1)
            weights = regression(features[kept], marks[kept], class_weights)
            said = features @ weights >= 0
            wrong[ratio] += sum(class_weights[marks[i]] for i in np.flatnonzero((part == fold) & (said != (marks == 1))))
    return min(RATIOS, key=lambda r: (wrong[r], -r))


def fit(texts: list[str], labels: list[int], class_sizes: dict[int, int]) -> Scorer:
    """A lexicon, cues and weights from labelled texts; ``class_sizes`` tells how many rows each class stands for."""
    marks = np.array(labels, np.int64)
    weights = tuple(class_sizes.get(k, 0) / max(1, int((marks == k).sum())) for k in (0, 1))
    if not len(marks):
        return Scorer([], weights=tuple(regression(np.zeros((0, FEATURES)), marks, weights)))
    vocabulary = Vocabulary([Counter(words(t.lower())) for t in texts])
    found, mass, sizes = vocabulary.sums(marks, 2)
    terms, _ = vocabulary.learn(found[1], mass[1], mass[0], sizes[1], sizes[0], best_ratio(vocabulary, marks, weights))
    scorer = Scorer(terms)
    often = np.flatnonzero(found[0, : len(vocabulary.words)] >= 2)
    common = frozenset(w for i in often if scorer.fuzzy.least_edits(w := vocabulary.words[i]) >= 0)
    scorer = Scorer(terms, common)
    # The weights are fitted on tones by cues of the other parts of the sample, so that the cues' own noise gets no weight.
    part = folds(marks)
    features = np.zeros((len(texts), FEATURES))
    for fold in range(FOLDS):
        kept = np.flatnonzero(part != fold)
        scorer.cues = learn_cues(scorer, [texts[i] for i in kept], marks[kept])
        for i in np.flatnonzero(part == fold):
            features[i] = scorer.features(texts[i])
    scorer.cues = learn_cues(scorer, texts, marks)
    scorer.weights = regression(features, marks, weights)
    return scorer


def learn_from(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Scorer:
    """Fits on at most about ``per_class`` labelled documents of each class, drawn by a hash of the id.

    Ids are drawn from the labels alone, so the documents are only read and filtered, never shuffled; what is broadcast and
    collected is bounded by ``per_class`` and LONGEST. Of several labels of an id the largest counts, of several texts of an id
    the least; null ids, labels and texts are passed over. Without a toxic label the lexicon is empty and every score is low.
    """
    slim = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in slim.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = F.lit(0.0)
    for k, n in counts.items():
        limit = F.when(F.col("toxic") == k, min(1.0, per_class / n)).otherwise(limit)
    drawn = slim.where(unit_hash(F.lit(6), "doc_id") < limit)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").where(F.char_length("text") <= LONGEST)
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], counts)


@lru_cache(maxsize=2)
def _scorer(terms: tuple[str, ...], common: frozenset[str], weights: tuple[float, ...], cues: tuple[tuple[str, float], ...]) -> Scorer:
    return Scorer(list(terms), common, weights, dict(cues))


def with_scores(docs: DataFrame, scorer: Scorer, out: str = "score", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and a double column ``out``: the chance of label 1. Only the text is an input.

    A column that is named ``out`` already is replaced.

    Whole texts are read. Null and empty texts get the score of a text without hits. The lexicon sent to the executors is
    bounded by the sample it was learned from.
    """
    sent = docs.sparkSession.sparkContext.broadcast((scorer.terms, scorer.common, tuple(map(float, scorer.weights)), tuple(sorted(scorer.cues.items()))))
    docs = docs.drop(out)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = _scorer(*sent.value)
        scores = pa.array([tool.score(t) for t in batch.column(at).to_pylist()], pa.float64())
        return pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out])

    return docs.mapInArrow(per_batch(run), StructType([*docs.schema.fields]).add(out, DoubleType()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 5, 0)
    scorer = learn_from(docs, table(spark, sf_dir, "labels").where(~out))
    scored = with_scores(docs.select("doc_id", "text"), scorer)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

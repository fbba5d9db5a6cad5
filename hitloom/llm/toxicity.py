"""Toxicity by a fuzzy lexicon with context-window scores.

Lexicon: words and word beginnings whose document odds are much higher in
documents labelled toxic, counted over all labelled training documents.
Matching: the Levenshtein automaton (one edit) is run along the lexicon's trie
as one machine whose states are sets of (trie node, edits); states are made
deterministic when first reached and remembered, so a word costs about one
look-up for each letter. Whole terms of ``FUZZY_FROM`` letters or more may be
misspelled, beginnings may not. Letters joined by a single digit or sign are
read both apart and as one word, in which the digit or sign is an edit.

Context: a hit weighs ``QUOTED`` of its weight if, within ``WINDOW`` words, it
stands between quotation marks or a word of reporting precedes it; else it
counts in full. Words of reporting are a short list, which the caller may
replace, and the words that training documents without the label have before
hits much more often than toxic ones. A logistic regression on a few sums of
these weights, fitted on a bounded sample, turns them into a score from 0 to 1.

Learning needs two narrow counts (candidates from toxic documents, then their
counts in all training documents), summed in the task first, and prediction is
one scan. Candidates reach the tasks by broadcast and labels their documents by
a broadcast join below counted bounds, else by shuffle. Every term that passes
is in the model: as each stands in ``LEAST_SHARE`` of the toxic documents, there
are at most 1 / ``LEAST_SHARE`` times as many as a toxic document has different
terms on average, however large the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.common import Recent, held_out, map_rows, read, sum_terms
from hitloom.runtime import Scratch

WORDS = regex.compile(r"[\p{L}\p{M}]+")
#: Words with what joins them: single digits or signs between letters.
TOKENS = regex.compile(r"[\p{L}\p{M}]+(?:[^\p{L}\p{M}\s][\p{L}\p{M}]+)*")
#: Lengths of word beginnings that may become terms.
STEMS = (4, 5, 6, 7)
#: A term is found in so many toxic training documents, at least, and in this share of them.
LEAST_DOCS, LEAST_SHARE = 3, 0.002
#: Smoothed log odds ratio from which a term is in the lexicon.
LEAST_ODDS = 2.0
#: A word of reporting is learned from so many clean documents with hits, at least, and from this share of them.
REPORTED_DOCS, REPORTED_SHARE = 10, 0.1
FUZZY_FROM = 5
WINDOW = 8
QUOTED = 0.35
#: Labelled documents that the regression reads, at most; the lexicon's counts cover all.
SAMPLE = 20_000
#: Labels (about 50 bytes each) and candidate terms (about 100) that one broadcast may hold.
BROADCAST_LABELS, BROADCAST_TERMS = 500_000, 200_000
#: Marks and words that tell quotation from abuse (fixed values).
MARKS = "\"“”„«»‹›"
REPORTING = frozenset(
    "said says wrote writes called quoted quotes word term insult sagte schrieb nannte zitiert wort dit disait appelait cité mot dijo llamó escribió palabra".split()
)


class FuzzyTrie:
    """A lexicon's trie and the Levenshtein automaton of one edit, intersected state by state."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], limit: int = 200_000):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]  # weight of the whole term that ends in a node
        self.fuzzy: list[float] = [0.0]  # the same if it may be misspelled
        self.stem: list[float] = [0.0]  # weight of the beginning that ends in a node
        for term, w in words.items():
            at = self._node(term)
            self.word[at] = max(self.word[at], w)
            if len(term) >= FUZZY_FROM:
                self.fuzzy[at] = max(self.fuzzy[at], w)
        for term, w in stems.items():
            at = self._node(term)
            self.stem[at] = max(self.stem[at], w)
        self.limit = limit
        self._reset()

    def _node(self, term: str) -> int:
        at = 0
        for c in term:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                for column in (self.word, self.fuzzy, self.stem):
                    column.append(0.0)
            at = self.next[at][c]
        return at

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, positions: set) -> int:
        """The number of a set of positions, closed under skipping a letter of the term."""
        exact = {n for n, e in positions if e == 0}
        closed = {(n, e) for n, e in positions if e == 0 or n not in exact}
        for n in exact:
            closed |= {(m, 1) for m in self.next[n].values() if m not in exact}
        key = frozenset(closed)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        reached = set()
        for n, e in self.states[state]:
            children = self.next[n]
            if c in children:
                reached.add((children[c], e))
            if e == 0:
                reached.add((n, 1))  # a letter too many
                reached |= {(m, 1) for m in children.values()}  # another letter
        to = self._state(reached)
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[float, float]:
        """Weight of the best term that the word is or begins with, and of the best one it misspells."""
        if len(self.states) > self.limit:
            self._reset()
        at, stem, node = self.start, 0.0, 0
        for c in word:
            if node is not None:
                node = self.next[node].get(c)
                if node is not None:
                    stem = max(stem, self.stem[node])
            to = self.steps[at].get(c)
            at = self._step(at, c) if to is None else to
            if not self.states[at] and node is None:
                break
        else:
            exact = max((self.word[n] for n, e in self.states[at] if e == 0), default=0.0)
            near = max((self.fuzzy[n] for n, e in self.states[at] if e == 1), default=0.0)
            return max(exact, stem), near if not exact and not stem else 0.0
        return stem, 0.0


def quoted(text: str, words: list[tuple[int, int, str]], i: int, reporting: frozenset = REPORTING) -> bool:
    """Whether the ``i``-th word stands in quotation marks or after a reporting word, within the window."""
    lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
    before = text[words[lo][0] : words[i][0]]
    after = text[words[i][1] : words[hi - 1][1] + 2]
    marked = sum(map(before.count, MARKS)) % 2 == 1 and any(m in after for m in MARKS)
    return marked or any(w in reporting for _, _, w in words[lo:i])


#: The match of a word that no term resembles.
NOTHING = (0.0, 0.0)
FEATURES = ["best", "best_fuzzy", "total", "share", "quoted"]


@dataclass
class Model:
    """Lexicon and regression; its size follows the number of terms, not of documents."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    reporting: frozenset = REPORTING
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    bias: float = -2.0


class Scorer:
    """Features and score of one text; remembers recent words."""

    def __init__(self, model: Model):
        self.model = model
        self.trie = FuzzyTrie(model.words, model.stems)
        self.seen = Recent(self._match)

    def _match(self, token: str) -> tuple[float, float]:
        """Best match of a token's words and, if one digit or sign joins two of them, of the whole."""
        words = WORDS.findall(token)
        found = [self.trie.match(w) for w in words]
        exact, near = max(a for a, _ in found), max(b for _, b in found)
        if len(words) == 2:
            near = max(near, self.trie.match(token)[1])
        return exact, near

    def hits(self, text: str | None) -> tuple[str, list, list, int]:
        """The text in lower case, its tokens with their places, the matches of each, and the number of tokens; no lists without a match."""
        low = text.lower() if text else ""
        tokens = TOKENS.findall(low)
        found = list(map(self.seen.__getitem__, tokens))
        if found.count(NOTHING) == len(found):
            return low, [], [], len(found)
        words, at = [], 0
        for t in tokens:  # no letter stands between two tokens, so that the next one is where its text is found first
            at = low.find(t, at)
            words.append((at, at := at + len(t), t))
        return low, words, found, len(found)

    def before(self, text: str | None) -> set[str] | None:
        """Words that stand before hits of a text, within the window, and are no hits; None without hits."""
        _, words, found, _ = self.hits(text)
        if not found:
            return None
        spots = [i for i, (a, b) in enumerate(found) if a or b]
        return {words[j][2] for i in spots for j in range(max(0, i - WINDOW), i) if not any(found[j])}

    def features(self, text: str | None) -> list[float]:
        low, words, found, n = self.hits(text)
        if not found:
            return [0.0] * len(FEATURES)
        best = fuzzy = total = told = 0.0
        for i, match in enumerate(found):
            if match != NOTHING:
                exact, near = match
                factor = 1.0
                if quoted(low, words, i, self.model.reporting):
                    factor, told = QUOTED, max(told, exact, near)
                best, fuzzy = max(best, factor * exact), max(fuzzy, factor * near)
                total += factor * (exact + 0.5 * near)
        return [best, fuzzy, math.log1p(total), total / (10 + n), told]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.features(text), self.model.weights) + self.model.bias)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms(text: str | None) -> set[str]:
    """Words (marked ``=``) and word beginnings (marked ``^``) of a text, each once."""
    words = set(WORDS.findall(text.lower())) if text else set()
    return {f"={w}" for w in words if len(w) > 2} | {f"^{w[:k]}" for w in words for k in STEMS if len(w) > k}


def _document_counts(rows: DataFrame, only: frozenset | None, names: str) -> DataFrame:
    """Documents for each term and class, summed in the task first; ``only`` names the terms of interest."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def find():
        keep = shared.value

        def run(row):
            found = terms(row[1])
            return [(t, row[0]) for t in (found if keep is None else found & keep)]

        return run

    counts = sum_terms(rows, find, "term string, toxic int, n bigint")
    return counts.groupBy("term").agg(*(F.sum(F.when(F.col("toxic") == int(k), F.col("n")).otherwise(0)).alias(k2) for k, k2 in zip("10", names.split(), strict=True)))


def lexicon(rows: DataFrame, toxic: int, clean: int, scratch: Scratch) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and of word beginnings from all labelled documents ``rows`` (y, t)."""
    least = max(LEAST_DOCS, LEAST_SHARE * toxic)
    first = _document_counts(rows.where("y = 1"), None, "a b").where(F.col("a") >= least).select("term")
    first, seen = scratch.counted(first, "candidates")
    if seen["n"] <= BROADCAST_TERMS:
        second = _document_counts(rows, frozenset(r[0] for r in first.collect()), "a b")
    else:
        second = _document_counts(rows, None, "a b").join(first, "term", "left_semi")
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    kept = second.withColumn("w", F.round(odds, 6)).where((F.col("w") >= LEAST_ODDS) & (F.col("a") >= least))
    found = kept.select("term", "w").collect()
    return tuple({r["term"][1:]: r["w"] for r in found if r["term"][0] == kind} for kind in "=^")


def reporting_words(chosen: DataFrame, model: Model) -> frozenset:
    """Words that a good part of the clean documents with hits has before them and toxic ones have much less often, in the sample ``chosen`` (y, t)."""
    shared = chosen.sparkSession.sparkContext.broadcast(model)

    def find():
        before = Scorer(shared.value).before
        return lambda row: [(w, row[0]) for w in {"", *words}] if (words := before(row[1])) is not None else []

    counts = sum_terms(chosen, find, "term string, toxic int, n bigint").groupBy("term").agg(*(F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
    total = counts.where("term = ''").first()
    if total is None:
        return frozenset()
    a, b = F.col("n0"), F.col("n1")
    odds = F.log((a + 0.5) / (total["n0"] - a + 0.5)) - F.log((b + 0.5) / (total["n1"] - b + 0.5))
    rows = counts.where((F.col("term") != "") & (a >= max(REPORTED_DOCS, REPORTED_SHARE * total["n0"]))).withColumn("w", F.round(odds, 6)).where(F.col("w") >= LEAST_ODDS)
    return frozenset(r["term"] for r in rows.collect())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", reporting: frozenset = REPORTING) -> Model:
    """Learn from documents with a label of 0 or 1; of several labels of one key the largest counts.

    Without both classes the model finds nothing. The regression and the words
    of reporting are learned from at most ``SAMPLE`` documents, chosen by a hash
    of key and text; equal rows teach these once.
    """
    scratch = Scratch(docs.sparkSession, "toxic")
    marks = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    marks, seen = scratch.counted(marks, "labels")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(marks) if seen["n"] <= BROADCAST_LABELS else marks, "k")
    sums = rows.agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean")).first()
    toxic, clean = sums["toxic"], sums["clean"]
    if not toxic or not clean:
        return Model(reporting=reporting)
    model = Model(*lexicon(rows.select("y", "t"), toxic, clean, scratch), reporting)
    rows = rows.withColumn("h", F.xxhash64("t"))
    sample = rows.select("k", "h", "y").orderBy(F.xxhash64("k", "h"), "k", "h").limit(SAMPLE).select("k", "h").distinct()
    chosen = scratch.table(rows.join(F.broadcast(sample), ["k", "h"]).dropDuplicates(["k", "h"]).select("y", "t"), "sample")
    model.reporting = reporting | reporting_words(chosen, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda c: [c[0], [scorer.features(t) for t in c[1]]]

    found = map_rows(chosen, make, "y int, x array<double>").orderBy("y", "x").toPandas()
    x, y = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES)), found["y"].to_numpy(float)
    model.weights, model.bias = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps on scaled features; a quoted hit never adds to a score."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) / len(y) - ridge * np.r_[w[:-1], 0]
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(z.shape[1])
        w += np.clip(np.linalg.solve(hess, grad), -2, 2)
    out = w[:-1] / scale
    out[FEATURES.index("quoted")] = min(0.0, out[FEATURES.index("quoted")])
    return out, float(w[-1])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, score, predicted.

    Null and empty texts, and texts without a hit, get the score of no hit.
    Only the text is an input; repeated rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def run(c):
            s = [scorer.score(t) for t in c[1]]
            return [c[0], s, [int(v >= 0.5) for v in s]]

        return run

    return map_rows(docs.select(key, text), make, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = score(docs, fit(docs.where(~held_out()), labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")

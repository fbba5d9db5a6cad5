"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade > k) = sigmoid(w x - t_k) with one weight vector w for all grades and
ordered thresholds t_1 < t_2 < ... The thresholds are kept in order by fitting
the first and the logarithms of the gaps. From the same probabilities follow
the expected grade and the tail probability that selection uses.

x holds hashed counts of the whole text: words, letter case, runs of marks,
words that repeat the word before and lines that repeat a line. Learning reads
a bounded sample of rated documents; its sparse counts are made on executors.
Prediction is one scan without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.common import Recent, held_out, map_rows, read
from hitloom.runtime import Scratch

#: Rated documents that are learned from, at most.
SAMPLE = 3_000
BUCKETS = 1 << 13
#: Ratings that one broadcast may hold (about 50 bytes each).
BROADCAST_RATINGS = 500_000
PARTS = re.compile(r"\w+|[^\w\s]+")


def _bucket(name: str) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) * 0x9E3779B1 % (1 << 32) >> 19


def _chunk(chunk: str) -> tuple[int, ...]:
    """Buckets of a stretch without white space."""
    out = []
    for part in PARTS.findall(chunk):
        if part[0].isalnum() or part[0] == "_":
            shape = "digit" if part.isdigit() else "upper" if len(part) > 1 and part.isupper() else "title" if part[0].isupper() else "lower"
            out += [_bucket(f"w{part.lower()}"), _bucket(f"s{shape}")]
        else:
            out.append(_bucket(f"m{part}"))
    return tuple(out)


class Hasher:
    """Sparse features of one text; remembers recent chunks."""

    def __init__(self):
        self.chunks = Recent(_chunk)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Bucket numbers and values of unit length."""
        words = text.split() if text else []
        total = np.bincount(np.fromiter(chain.from_iterable(map(self.chunks.__getitem__, words)), np.int64), minlength=BUCKETS).astype(float)
        total[_bucket("repeat")] += sum(map(eq, words, words[1:]))
        lines = [x for x in text.split("\n") if x.strip()] if text else []
        total[_bucket("line again")] += 5 * (len(lines) - len(set(lines)))
        total[_bucket(f"length {len(words).bit_length()}")] += 1
        at = np.flatnonzero(total)
        v = np.sqrt(total[at])
        return at, v / np.linalg.norm(v)


@dataclass
class Model:
    """Grades in order, shared weights and thresholds; without grades it gives null results."""

    grades: list[float] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def above(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold, never increasing."""
        return 1 / (1 + np.exp(-np.clip(float(self.weights[at] @ v) - self.cuts, -30, 30)))


def _order(raw: np.ndarray) -> np.ndarray:
    """Thresholds from the first and the logarithms of the gaps."""
    return raw[0] + np.r_[0.0, np.cumsum(np.exp(raw[1:]))]


def fit_ordinal(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200, rate: float = 0.3, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds for grades 0 to ``classes`` - 1, by Adam on the likelihood."""
    share = np.clip([(y > k).mean() for k in range(classes - 1)], 0.01, 0.99)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(classes - 1))
    raw = np.r_[start[:1], np.log(np.maximum(np.diff(start), 1e-2))]
    w = np.zeros(x.shape[1], np.float32)
    state = [[np.zeros_like(p, float), np.zeros_like(p, float)] for p in (w, raw)]
    for t in range(1, steps + 1):
        cuts = _order(raw)
        f = x @ w
        # grade y lies between cuts[y - 1] and cuts[y]
        s = 1 / (1 + np.exp(-np.clip(f[:, None] - np.r_[-np.inf, cuts, np.inf], -30, 30)))
        s[:, 0], s[:, -1] = 1.0, 0.0
        row = np.arange(len(y))
        hi, lo = s[row, y], s[row, y + 1]
        p = np.maximum(hi - lo, 1e-9)
        g_hi, g_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        grad_f = -(g_hi - g_lo) / len(y)
        grad_cut = np.zeros(classes + 1)
        np.add.at(grad_cut, y, g_hi / len(y))
        np.add.at(grad_cut, y + 1, -g_lo / len(y))
        tail = np.cumsum(grad_cut[1:-1][::-1])[::-1]  # a gap moves all later thresholds
        grads = (x.T @ grad_f.astype(np.float32) + ridge * w, np.r_[tail[0], tail[1:] * np.exp(raw[1:])])
        new = []
        for q, g, (m, v) in zip((w, raw), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            new.append(q - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8))
        w, raw = new[0].astype(np.float32), new[1]
    return w, _order(raw)


def fit(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", rating: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` rated documents, chosen by a hash of key and text.

    Any number of grades; null ratings teach nothing; of several ratings of one
    key the largest counts, and equal rows teach once. With fewer than two
    grades there is no threshold.
    """
    marks = ratings.where(F.col(rating).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(rating).cast("double")).alias("y"))
    scratch = Scratch(docs.sparkSession, "ordinal")
    marks, seen = scratch.counted(marks, "ratings")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    keys = rows.select("k", "h").join(F.broadcast(marks) if seen["n"] <= BROADCAST_RATINGS else marks, "k")
    chosen = keys.orderBy(F.xxhash64("k", "h"), "k", "h").limit(sample).distinct()
    rows = rows.join(F.broadcast(chosen), ["k", "h"]).dropDuplicates(["k", "h"]).select("y", "t")

    def make():
        hasher = Hasher()

        def run(c):
            found = [hasher(t) for t in c[1]]
            return [c[0], [a.tolist() for a, _ in found], [v.tolist() for _, v in found]]

        return run

    found = map_rows(rows, make, "y double, i array<int>, v array<float>").orderBy("y", "i", "v").toPandas()
    scratch.release(marks)
    grades = sorted(found["y"].unique())
    if len(grades) < 2:
        return Model([float(g) for g in grades])
    x = np.zeros((len(found), BUCKETS), np.float32)
    for row, (i, v) in enumerate(zip(found["i"], found["v"], strict=True)):
        x[row, i] = v
    y = np.array([grades.index(g) for g in found["y"]])
    return Model([float(g) for g in grades], *fit_ordinal(x, y, len(grades)))


def grade(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float | None = None) -> DataFrame:
    """One row for each row of ``docs``: key, expected_grade, tail, kept.

    ``tail`` is the probability of a grade of ``least`` or more (by default the
    highest), ``kept`` marks a tail of 0.5 or more. Null and empty texts are
    texts without a word. Only the text is an input; a model without grades
    gives null grades and keeps nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cut = 0 if not model.grades else sum(g < (model.grades[-1] if least is None else least) for g in model.grades)

    def make():
        m, hasher = shared.value, Hasher()
        steps = np.diff(m.grades)

        def run(c):
            if not m.grades:
                return [c[0], [None] * len(c[0]), [None] * len(c[0]), [False] * len(c[0])]
            above = [np.r_[1.0, m.above(*hasher(t)), 0.0] for t in c[1]]
            tails = [float(a[min(cut, len(a) - 1)]) for a in above]
            return [c[0], [float(m.grades[0] + a[1:-1] @ steps) for a in above], tails, [t >= 0.5 for t in tails]]

        return run

    return map_rows(docs.select(key, text), make, f"`{key}` {docs.schema[key].dataType.simpleString()}, expected_grade double, tail double, kept boolean")


def op7_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = grade(docs, fit(docs.where(~held_out()), labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "expected_grade", "tail", "kept")

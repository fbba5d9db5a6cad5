"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. One binary classifier for each bit
reads hashed counts of letter n-grams of the whole text and says on which side
of the bit the language stands. Decoding adds up, for each codeword, the
logistic loss of the bits, weighted by how well a bit separates its two sides
in training (loss-weighted decoding); the smallest loss names the language and
a small lead over the second marks an ambiguous text.

Training reads a bounded sample of labelled documents: the ``SAMPLE`` smallest
keyed hashes. The sample's counts are made on executors; only these bounded
arrays reach the driver. Prediction is one scan without a shuffle.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.common import held_out, map_rows, read

#: Labelled documents that are learned from, at most.
SAMPLE = 2_000
BUCKETS = 1 << 13
#: Up to so many languages the code is exhaustive, beyond it random with so many bits.
EXHAUSTIVE, RANDOM_BITS = 5, 31
#: Lead of the best language's probability below which a text counts as ambiguous.
AMBIGUOUS = 0.1
NOT_LETTERS = regex.compile(r"\P{L}+")


def code(classes: int) -> np.ndarray:
    """Codewords of +1 and -1, one row a class: every split once if there are few classes, else random distinct splits."""
    if classes <= EXHAUSTIVE:
        rows = [(1, *rest) for rest in itertools.product((1, -1), repeat=classes - 1)]
        columns = [r for r in rows if -1 in r] or rows
        return np.array(columns).T
    rng = np.random.default_rng(11)
    chosen: set[tuple] = set()
    while len(chosen) < RANDOM_BITS:
        r = rng.permutation(np.where(np.arange(classes) % 2, 1, -1))
        chosen.add(tuple(r * r[0]))
    return np.array(sorted(chosen)).T


def counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the 1 to 3 byte letter n-grams of a text; None if it has no letter."""
    plain = NOT_LETTERS.sub(" ", text).lower() if text else ""
    if not plain.strip():
        return None
    b = np.frombuffer(f" {plain} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    pair = b[:-1] * np.uint32(257) + b[1:]
    triple = pair[:-1] * np.uint32(263) + b[2:]
    total = np.zeros(BUCKETS)
    for k, g in enumerate((b, pair, triple)):
        total += np.bincount((g * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(19), minlength=BUCKETS)
    return total


def features(total: np.ndarray) -> np.ndarray:
    x = np.sqrt(total)
    return x / np.linalg.norm(x)


@dataclass
class Model:
    """What prediction needs: a few hundred kilobytes, independent of the number of documents."""

    labels: list[str]
    codes: np.ndarray  # classes x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of every class for one text or for rows of texts."""
        f = x @ self.weights + self.bias
        return np.logaddexp(0, -f[..., None, :] * self.codes) @ self.trust

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability-like score and whether the text is ambiguous; ``und`` without a letter."""
        total = counts(text)
        if total is None or not self.labels:
            return "und", 0.0, True
        loss = self.losses(features(total))
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        first, *rest = np.argsort(-p, kind="stable")
        return self.labels[first], float(p[first]), bool(rest and p[first] - p[rest[0]] < AMBIGUOUS)


def fit_bits(x: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.5, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions for all columns of ``y`` (+1, -1) at once by Adam on the full sample."""
    w = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        f = x @ w[:-1] + w[-1]
        g = -y / (1 + np.exp(np.clip(y * f, -30, 30))) / len(x)
        grad = np.vstack([x.T @ g + ridge * w[:-1], g.sum(axis=0)])
        m += 0.1 * (grad - m)
        v += 0.02 * (grad * grad - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
    return w[:-1], w[-1]


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` rows with text and language, chosen by a hash of key and text.

    Rows with a null key or language or no letter teach nothing, equal rows
    teach once. Without any row the model answers ``und``; with one language it
    answers that one.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    known = known.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.xxhash64(text).alias("h"))
    own = ["k", "h", "l"]
    chosen = known.select(*own).orderBy(F.xxhash64("k", "h"), *own).limit(sample)
    rows = known.join(F.broadcast(chosen.distinct()), own).dropDuplicates(own)

    def make():
        def run(c):
            made = [(lab, total) for lab, t in zip(c[0], c[1], strict=True) if (total := counts(t)) is not None]
            at = [np.flatnonzero(total) for _, total in made]
            return [[lab for lab, _ in made], [i.tolist() for i in at], [np.log2(total[i]).tolist() for (_, total), i in zip(made, at, strict=True)]]

        return run

    found = map_rows(rows.select("l", "t"), make, "l string, i array<int>, c array<float>").orderBy("l", "i", "c").toPandas()
    labels = sorted(found["l"].unique())
    codes = code(len(labels)) if len(labels) > 1 else np.ones((len(labels), 1))
    x = np.zeros((len(found), BUCKETS), np.float32)
    for row, (i, c) in enumerate(zip(found["i"], found["c"], strict=True)):
        total = np.zeros(BUCKETS)
        total[i] = np.exp2(c)
        x[row] = features(total)
    if len(labels) < 2:
        return Model(labels, codes, np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    own = np.array([labels.index(v) for v in found["l"]])
    y = codes[own].astype(np.float32)
    w, b = fit_bits(x, y)
    right = ((x @ w + b) * y > 0).mean(axis=0)
    trust = np.clip(2 * right - 1, 0.01, None)
    model = Model(labels, codes, w, b, trust / trust.sum())
    model.trust = model.trust * _sharpness(model.losses(x), own)
    return model


def _sharpness(losses: np.ndarray, own: np.ndarray) -> float:
    """One factor on all losses under which the softmax over codewords fits the sample best."""
    best = min(
        (-np.log(np.clip((e := np.exp(k * (losses.min(axis=1, keepdims=True) - losses)))[np.arange(len(own)), own] / e.sum(axis=1), 1e-9, 1)).mean(), k)
        for k in np.geomspace(0.5, 32, 25)
    )
    return float(best[1])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, lang_pred, score, ambiguous.

    Null, empty and letterless texts are ``und`` with score 0. Only the text is
    an input of a prediction; equal texts get equal answers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.predict

        def run(c):
            out = [predict(t) for t in c[1]]
            return [c[0], *map(list, zip(*out, strict=True))] if out else [[], [], [], []]

        return run

    return map_rows(docs.select(key, text), make, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` whose language is told without ambiguity, with the same columns.

    Texts without a letter go too. Prediction keeps the row beside its text, so
    that nothing is joined back.
    """
    shared = spark.sparkContext.broadcast(fit(docs.where(~held_out())))

    def make():
        predict = shared.value.predict

        def run(c):
            keep = [r for r in zip(*c, strict=True) if (p := predict(r[at]))[0] != "und" and not p[2]]
            return list(map(list, zip(*keep, strict=True))) if keep else [[] for _ in c]

        return run

    at = docs.columns.index("text")
    return map_rows(docs, make, docs.schema)

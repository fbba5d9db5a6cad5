"""Quality rules judged by host.

One scan computes per document the counts that the rules read. Failures of
each rule are summed by host (a partial aggregate, so a host with a third of
all rows is no hot task), a host's rates are shrunk towards the corpus by a
beta prior fitted to the hosts' failures by beta-binomial moments (the noise of
counting is taken off, hosts weigh by their documents), and a host is rejected
if the shrunk rate of any rule is above ``HOST_LIMIT``. The verdicts, one
narrow row per host, are joined back to documents: broadcast below a counted
bound, else by a shuffle join that AQE can split.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.common import Recent, map_rows, read
from hitloom.runtime import Scratch

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Words of a window whose repeats count.
WINDOW = 5
#: Shrunk failure rate above which a host is rejected.
HOST_LIMIT = 0.5
#: Documents that the prior weighs: where the hosts tell nothing, at least, and at most.
FEW_DOCS, LEAST_DOCS, MOST_DOCS = 10.0, 0.01, 10_000.0
BROADCAST_HOSTS = 500_000

METRICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


class Counter:
    """The counts of one text."""

    def __init__(self):
        self.words = Recent(lambda w: int.from_bytes(blake2b(w, digest_size=8).digest(), "little"))

    def repeated(self, words: list[bytes]) -> int:
        """Words covered by a window of ``WINDOW`` words that is found twice or more."""
        if len(words) <= WINDOW:
            return 0
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(h) - WINDOW + 1
        key = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            key = (key ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if not same.any():
            return 0
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        steps = np.zeros(len(h) + 1, np.int64)
        steps[:n] += twice
        steps[WINDOW:][:n] -= twice
        return int((np.cumsum(steps) > 0).sum())

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return [0] * len(METRICS)
        words = text.encode("utf-8", "surrogatepass").split()
        seen: set[str] = set()
        lines = dup = 0
        for line in text.split("\n"):
            if line.strip(SPACES):
                lines += 1
                dup += line in seen
                seen.add(line)
        chars = len(text) - sum(map(text.count, SPACES))
        return [len(words), chars, sum(map(text.count, SYMBOLS)), lines, dup, self.repeated(words)]


def metrics(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Rows (doc_id, host, then ``METRICS``), one for each row of ``docs``."""

    def make():
        count = Counter()

        def run(c):
            rows = [count(t) for t in c[2]]
            return [c[0], c[1], *(list(v) for v in zip(*rows, strict=True))] if rows else [[] for _ in range(2 + len(METRICS))]

        return run

    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, host string, " + ", ".join(f"{m} bigint" for m in METRICS)
    return map_rows(docs.select(F.col(key), F.col(host).cast("string"), F.col(text)), make, schema)


def rules() -> dict[str, Column]:
    """Failures of a document. The first two are the base rules."""
    c = F.col
    return {
        "short": c("n_words") < 10,
        "repeated": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": 2 * c("n_symbols") > c("n_words"),
        "dup_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
    }


def beta_prior(hosts: int, docs: int, squares: float, failed: int, ratio: float) -> tuple[float, float]:
    """Beta parameters of hosts' failure rates by beta-binomial moments.

    ``squares`` is the sum of n^2 over hosts and ``ratio`` that of k^2 / n, for
    k failures among a host's n documents. With m the overall rate and rho the
    correlation of two documents of one host, sum n (k / n - m)^2 is expected
    to be m (1 - m) ((H - 1) + (N - sum n^2 / N - (H - 1)) rho). The prior's
    strength is (1 - rho) / rho documents, at most ``MOST_DOCS`` where hosts
    differ by chance alone; where nothing can be told (one host, one document
    a host, no failure or nothing but failures) it is ``FEW_DOCS``.
    """
    mean = failed / docs if docs else 0.0
    spread, span = mean * (1 - mean), docs - (squares / docs if docs else 0.0) - (hosts - 1)
    strength = FEW_DOCS
    if spread > 0 and span > 0:
        rho = ((ratio - failed * mean) / spread - (hosts - 1)) / span
        strength = min(max((1 - rho) / rho, LEAST_DOCS), MOST_DOCS) if rho > 0 else MOST_DOCS
    return mean * strength, (1 - mean) * strength


def host_verdicts(found: DataFrame) -> DataFrame:
    """Rows (host, n_docs, rate_<rule> shrunk, host_ok) from per-document metrics."""
    names, scratch = list(rules()), Scratch(found.sparkSession, "hosts")
    hosts = scratch.table(found.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.count_if(v).alias(k) for k, v in rules().items())), "hosts")
    n = F.col("n_docs")
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.sum(n).alias("docs"), F.sum(n.cast("double") * n).alias("squares"),
        *(e for k in names for e in (F.sum(k).alias(f"k_{k}"), F.sum(F.col(k).cast("double") * F.col(k) / n).alias(f"r_{k}"))),
    ).first()
    prior = {k: beta_prior(sums["hosts"], sums["docs"] or 0, sums["squares"] or 0.0, sums[f"k_{k}"] or 0, sums[f"r_{k}"] or 0.0) for k in names}
    rate = {k: (F.col(k) + F.lit(a)) / (n + F.lit(a + b)) for k, (a, b) in prior.items()}
    return hosts.select("host", "n_docs", *(r.alias(f"rate_{k}") for k, r in rate.items()), (F.greatest(*rate.values()) <= HOST_LIMIT).alias("host_ok"))


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row for each row of ``docs``: key, the counts, base_failed, kept, then n_lines and host_ok.

    Null and empty texts have no words and fail. A null host is a host of its
    own. Repeated rows count as often as they stand; other columns are not
    read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    found = scratch.table(metrics(docs, key, text, host), "metrics")
    verdicts = scratch.table(host_verdicts(found).select(F.col("host").alias("h"), "host_ok"), "verdicts")
    few = verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    judged = found.join(F.broadcast(verdicts) if few else verdicts, F.col("host").eqNullSafe(F.col("h")))
    base = rules()["short"] | rules()["repeated"]
    counts = [m for m in METRICS if m != "n_lines"]
    return judged.select(F.col("doc_id").alias(key), *counts, base.alias("base_failed"), (~base & F.col("host_ok")).alias("kept"), "n_lines", "host_ok")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs),
per_line AS (SELECT r, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
dup AS (SELECT r, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM per_line GROUP BY r),
win AS (
  SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest(range(0, 5)) AS d) GROUP BY r),
counted AS (
  SELECT docs.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM docs LEFT JOIN dup ON docs.r = dup.r LEFT JOIN covered ON docs.r = covered.r),
failed AS (
  SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2, 2 * n_symbols > n_words AS f3,
    10 * n_dup_lines > 3 * n_lines AS f4, word_chars < 2 * n_words OR word_chars > 15 * n_words AS f5 FROM counted),
hosts AS (
  SELECT source AS h, count(*) AS n, unnest([1, 2, 3, 4, 5]) AS rule,
    unnest([count(*) FILTER (f1), count(*) FILTER (f2), count(*) FILTER (f3), count(*) FILTER (f4), count(*) FILTER (f5)]) AS k
  FROM failed GROUP BY source),
moments AS (
  SELECT rule AS q, CAST(count(*) AS DOUBLE) AS n_hosts, CAST(sum(n) AS DOUBLE) AS docs, sum(CAST(n AS DOUBLE) * n) AS squares,
    sum(k) / CAST(sum(n) AS DOUBLE) AS m, sum(k) AS failed, sum(CAST(k AS DOUBLE) * k / n) AS ratio FROM hosts GROUP BY rule),
spreads AS (SELECT *, m * (1 - m) AS v, docs - squares / docs - (n_hosts - 1) AS span FROM moments),
rhos AS (SELECT *, CASE WHEN v > 0 AND span > 0 THEN ((ratio - failed * m) / v - (n_hosts - 1)) / span END AS rho FROM spreads),
prior AS (
  SELECT q, m, CASE WHEN rho IS NULL THEN 1e1 WHEN rho > 0 THEN least(greatest((1 - rho) / rho, 1e-2), 1e4) ELSE 1e4 END AS s FROM rhos),
verdicts AS (SELECT h, max((k + m * s) / (n + s)) <= 5e-1 AS host_ok FROM hosts JOIN prior ON rule = q GROUP BY h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND host_ok AS kept, n_lines, host_ok
FROM failed JOIN verdicts ON source IS NOT DISTINCT FROM h
"""

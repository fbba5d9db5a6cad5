"""Token counts by count-only Viterbi over a unigram vocabulary.

The vocabulary is the list of pieces and scores of a public sentencepiece file,
read as a unigram model: a text's tokens are the sequence of pieces with the
greatest sum of scores. An Aho-Corasick automaton enumerates the pieces that
end at each position; for each position only the best score and the number of
tokens on its path are carried, no lattice and no back pointers. Rules that
decide ties are the tokenizers library's for such a model: scores are summed
as 64-bit numbers, of equal sums the one whose last piece starts first stays, a
character that is no piece costs ten below the least score and counts as one
token for each of its UTF-8 bytes (byte fallback).

Every piece has its word-start signs at its beginning, so every path passes
each place before a run of them: the text is cut there and the sum goes on from
stretch to stretch, as sums of 64-bit numbers depend on what they start from.
Where all scores are multiples of one power of two, and small enough for exact
sums, they do not: recent stretches are then remembered. One scan, no shuffle.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from hitloom.llm.bpe import _field
from hitloom.llm.common import Recent, map_rows, read, sent

START = "▁"
UNKNOWN_COST = 10.0
#: Sums of scores that are multiples of 2^-EXACT_BITS are exact below 2^(53 - EXACT_BITS).
EXACT_BITS = 8


class UnigramCounter:
    def __init__(self, pieces: dict[str, float]):
        if any(START in p.lstrip(START) for p in pieces):
            raise ValueError("a piece has a word-start sign after its beginning")
        self.machine = ahocorasick.Automaton()
        for p, s in pieces.items():
            self.machine.add_word(p, (len(p), float(s)))
        self.machine.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_COST
        self.known = frozenset(p for p in pieces if len(p) == 1)
        self.cut = re.compile(f"{START}*[^{START}]+|{START}+").findall
        scores = [*pieces.values(), self.unknown]
        self.most = max(map(abs, scores))
        self.exact = all(float(v) * 2**EXACT_BITS % 1 == 0 for v in scores)
        self.recent = Recent(self._best)

    def _best(self, s: str, before: float = 0.0) -> tuple[int, float]:
        """Number of tokens of the best path over ``s``, and the score after it if it was ``before``."""
        score, count = [None] * (len(s) + 1), [0] * (len(s) + 1)
        score[0] = before
        ends: list[list] = [[] for _ in s]
        for end, match in self.machine.iter(s):
            ends[end].append(match)
        for i, c in enumerate(s):
            best, tokens = None, 0
            found = ends[i] if c in self.known else [*ends[i], (1, self.unknown)]
            for length, worth in sorted(found, reverse=True):  # longest first: it starts first
                total = score[i + 1 - length] + worth
                if best is None or total > best:
                    best, tokens = total, count[i + 1 - length] + (1 if length > 1 or c in self.known else len(c.encode("utf-8", "surrogatepass")))
            score[i + 1], count[i + 1] = best, tokens
        return count[-1], score[-1]

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens and score of a text; a sign stands before it and for every space."""
        if not text:
            return 0, 0.0
        n, total = 0, 0.0
        exact = self.exact and (len(text) + 1) * self.most < 2 ** (53 - EXACT_BITS)
        for part in self.cut(START + text.replace(" ", START)):
            if exact:
                a, b = self.recent[part]
                n, total = n + a, total + b
            else:
                a, total = self._best(part, total)
                n += a
        return n, total


def sentencepiece_vocabulary(path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece file with their scores (no control, byte, unused or unknown pieces)."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unused(i) or m.is_unknown(i)))
    return {m.id_to_piece(i): m.get_score(i) for i in ids}


_loaded: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    """One counter for each Python worker and file; :func:`count_tokens` sends the file at ``path`` on the driver to the executors."""
    if path not in _loaded:
        _loaded[path] = UnigramCounter(sentencepiece_vocabulary(path))
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, n_tokens, score (sum over the best path).

    Null and empty texts have no tokens and score 0; nothing is cut off, other
    columns are not read, repeated rows and null keys stay as they are.
    """

    file = sent(docs.sparkSession, path)

    def make():
        count = counter(file()).count

        def run(c):
            out = [count(t) for t in c[1]]
            return [c[0], [n for n, _ in out], [s for _, s in out]]

        return run

    return map_rows(docs.select(key, text), make, f"{_field(docs, key)}, n_tokens bigint, score double")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), piece_path())

"""Byte-pair encoding and decoding with a public tokenizer file.

Method: contiguous rank array. A word's symbols stand in one list of part
boundaries with the merge ranks of adjacent parts beside it; the smallest rank
is found by scanning, its boundary deleted and the two neighbouring ranks are
looked up again. Words that are too long for scanning use the same rule with a
heap over the boundaries, so that a text without spaces stays cheap.

Documents are independent: one scan, no shuffle. Each task loads the tokenizer
file once and remembers the codes of recent short words, within a bound on their lengths.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from hitloom.llm.common import Recent, map_rows, read, sent

#: Words above this many symbols are merged with a heap.
LONG = 64
NONE = 1 << 60
#: White space of the tokenizer's ``\s``, fixed by Unicode's White_Space property.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a word-end BPE file in the JSON format of the tokenizers library.

    Covers the parts such a file may name here: NFC, white space to one space,
    lower case, a split pattern, byte symbols and an end-of-word suffix.
    Special tokens in a text become their ids, as the library does by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split.replace(r"\s", SPACE), regex.V0).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.words = Recent(self._word, 12_000_000)
        self.chunks = Recent(self._chunk)
        self.spaces = regex.compile(f"[{SPACE}]+")

    def _word(self, word: str) -> list[int]:
        symbols = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.suffix
        ids = [self.vocab[s] for s in symbols]
        return self._merge(ids) if len(ids) <= LONG else self._merge_long(ids)

    def _merge(self, ids: list[int]) -> list[int]:
        """Parts are ids[bounds[i]]; ranks[i] is the rank of parts i and i + 1."""
        get = self.ranks.get
        bounds = list(range(len(ids)))
        ranks = [get(pair, (NONE, 0))[0] for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[bounds[i]] = get((ids[bounds[i]], ids[bounds[i + 1]]))[1]
            del bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[bounds[i - 1]], ids[bounds[i]]), (NONE, 0))[0]
            if i < len(ranks):
                ranks[i] = get((ids[bounds[i]], ids[bounds[i + 1]]), (NONE, 0))[0]
        return [ids[b] for b in bounds]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order: smallest rank first, leftmost at ties."""
        get = self.ranks.get
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(found[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (found := get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = get((a, b))[1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (found := get((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def _chunk(self, chunk: str) -> bytes:
        words = self.words
        return np.array([i for w in self.find(chunk) for i in words[w]], "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # case is mapped letter by letter
        text = text.lower()
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return b"".join(map(self.chunks.__getitem__, self.spaces.split(text) if odd else text.split()))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; nothing for null or empty text."""
        if not text:
            return b""
        if self.at_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self.at_special.split(text))

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space: these files name no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One tokenizer for each Python worker and file; the operators send the file at ``path`` on the driver to the executors."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, ids array<long>)``, one for each row of ``docs``.

    Null and empty texts, and texts of white space, have no ids. Repeated rows
    and null keys stay as they are; other columns are not read.
    """

    file = sent(docs.sparkSession, path)

    def make():
        bpe = tokenizer(file())
        return lambda c: [c[0], [np.frombuffer(bpe.encode(t), "<u4").tolist() for t in c[1]]]

    return map_rows(docs.select(key, text), make, f"{_field(docs, key)}, ids array<bigint>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows ``(key, text)`` from arrays of ids; null arrays give empty texts."""

    file = sent(encoded.sparkSession, path)

    def make():
        bpe = tokenizer(file())
        return lambda c: [c[0], [bpe.decode(np.array(i or [], "<u4").tobytes()) for i in c[1]]]

    return map_rows(encoded.select(key, ids), make, f"{_field(encoded, key)}, text string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every row; return counts and SHA-256 of the ids and of the decoded text.

    Same cases as :func:`encode`; a row without ids has the digests of nothing.
    """

    file = sent(docs.sparkSession, path)

    def make():
        bpe = tokenizer(file())

        def run(c):
            ids = [bpe.encode(t) for t in c[1]]
            back = [bpe.decode(i).encode("utf-8", "surrogatepass") for i in ids]
            return [c[0], [len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], [hashlib.sha256(b).hexdigest() for b in back]]

        return run

    return map_rows(docs.select(key, text), make, f"{_field(docs, key)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _field(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}"


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), word_bpe_path())

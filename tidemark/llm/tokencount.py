"""Exact token counts of whole texts by the whole-token shortcut.

Offline, each vocabulary string that is a pre-token of its own is encoded alone; those that give one token are the proven
ones.  A text is cut into pre-tokens by the tokenizer's public pattern; proven pre-tokens count one without any merging,
all others are merged by the library's model, and remembered up to a bound.  Also offline, the
pattern's character classes are compared with the library's own for every assigned code point; a text with a code point on
which they differ (or an unassigned one), or with the string of an added token, is encoded by the library as a whole, so the
counts are the library's.

Defined results: null and empty texts have no bytes and no tokens; texts of any length are cut lazily; repeated rows count
alike; other columns are carried as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from itertools import islice

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_texts
from tidemark.llm.store import shared

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
_REMEMBER = 1 << 19  # merged pre-tokens of up to _SHORT characters that a task keeps
_SHORT = 64
_SLICE = 1 << 20  # pre-tokens of a text that are held at a time


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def proof(path: str, pattern: str) -> tuple[frozenset[str], str, tuple[str, ...]]:
    """The pre-tokens proven to be one token; ranges of code points not proven to be cut alike; added tokens."""
    tokenizer = _load(path)
    cut = regex.compile(pattern)
    alone = [s for s in (tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())) if s and cut.fullmatch(s) and cut.findall(s) == [s]]
    proven = frozenset(s for s, e in zip(alone, tokenizer.encode_batch(alone, add_special_tokens=False), strict=True) if len(e.ids) == 1)
    differ = bytearray(unicodedata.category(chr(i)) in ("Cn", "Co", "Cs") for i in range(sys.maxunicode + 1))
    points = [chr(i) for i, skip in enumerate(differ) if not skip]
    for at in range(0, len(points), 256):
        own_points = points[at : at + 256]
        for before in ("a", "1", "!"):
            probe = "".join(before + c + "\n\nx" for c in own_points)
            own = {m.start() for m in cut.finditer(probe)}
            its = {a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(probe)}
            for x in own ^ its:
                differ[ord(own_points[x // 5])] = 1
    edges = [i for i in range(sys.maxunicode + 2) if (i <= sys.maxunicode and differ[i]) != (i > 0 and differ[i - 1] == 1)]
    ranges = "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))
    return proven, ranges, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Counter:
    def __init__(self, path: str, pattern: str, proven: frozenset[str], differ: str, added: tuple[str, ...]) -> None:
        self.tokenizer, self.cut = _load(path), regex.compile(pattern)
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.added = added
        self.differ = re.compile(f"[{differ}]") if differ else None
        self.alike: dict[str, bool] = {}  # by character: whether it is cut as the library does
        self.base = dict.fromkeys(proven, 1)
        self.cost = dict(self.base)

    def _sum(self, found: list[str]) -> int:
        cost = self.cost
        if new := list(set(found).difference(cost)):
            merge = self.tokenizer.model.tokenize
            for x in new:
                cost[x] = len(merge(x.encode().decode("latin-1").translate(self.letters)))
        total = sum(map(cost.__getitem__, found))
        for x in new:
            if len(x) > _SHORT:
                del cost[x]
        if len(cost) > len(self.base) + _REMEMBER:
            self.cost = dict(self.base)
        return total

    def _cut_alike(self, text: str) -> bool:
        if self.differ is None or text.isascii():
            return True
        alike = self.alike
        for c in set(text):
            if c not in alike:
                alike[c] = not self.differ.match(c)
            if not alike[c]:
                return False
        return True

    def count(self, text: str) -> int:
        if any(x in text for x in self.added) or not self._cut_alike(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(text) <= _SLICE:
            return self._sum(self.cut.findall(text))
        found, total = (m.group() for m in self.cut.finditer(text)), 0
        while part := list(islice(found, _SLICE)):
            total += self._sum(part)
        return total


_COUNTERS: dict[tuple[str, str], Counter] = {}


def _counter(path: str, pattern: str, *proof_: object) -> Counter:
    """One counter for all tasks of a worker process."""
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = Counter(path, pattern, *proof_)
    return _COUNTERS[path, pattern]


def count_tokens(docs: DataFrame, *, text_col: str = "text", carry: Sequence[str] = ("doc_id",), path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """row (the carried columns), n_bytes, n_tokens.  path: a byte-level BPE vocabulary of the tokenizers library whose
    pre-tokenizer cuts by `pattern`."""
    path = path or public_tokenizers.path(VOCABULARY)
    model = shared(docs.sparkSession, (path, pattern, *proof(path, pattern)))

    def make():
        count = _counter(*model.value).count
        return lambda texts: [pa.array([0 if t is None else len(t) for t in texts.cast(pa.binary()).to_pylist()], pa.int64()), pa.array([count(t) if t else 0 for t in texts.to_pylist()], pa.int64())]

    return map_texts(docs, text_col, carry, make, "n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

"""Token counts of a byte-level BPE by rank-synchronous merging: the pre-tokens of a batch are one ragged array, every
sequence applies its lowest-rank pair at the same time, and the symbols that survive are counted."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinework.llm.common import bounded_batches, held, joined, pieces
from brinework.llm.word_ids import Cache, byte_letters

#: White space of the library's patterns: Unicode White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokens of the byte-level pre-tokenizer.
_PRE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_PRE_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Runs without ASCII white space, with one space before; a pre-token never spans two of them.
_CHUNK = re.compile(rb" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: White space beyond ASCII, in UTF-8; texts with any of it are split by the full pattern.
_WIDE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CACHE = 200_000


class MergeCounter:
    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        self.specials = [t["content"] for t in model["added_tokens"]]
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        self.size = len(vocab)
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        #: For each merge, sorted by the key of its pair: its rank and its symbol.
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.symbols = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        self.bytes = np.array([vocab[x] for x in byte_letters()], dtype=np.int64)
        self.chunks, self.parts = Cache(CACHE), Cache(CACHE)
        self.special = re.compile("|".join(re.escape(s) for s in self.specials) or r"(?!)")

    def merged(self, parts: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token when no pair of neighbours has a rank."""
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        symbols = self.bytes[np.frombuffer(b"".join(parts), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(parts)), sizes)
        left = sizes.copy()
        none = len(self.keys)
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(np.append(rank, none), first)
            active = lowest < none
            if not active.any():
                break
            # sequences without a pair are done
            here = np.repeat(active, np.diff(np.append(first, len(owner))))
            low = np.repeat(lowest, np.diff(np.append(first, len(owner))))
            hit = np.append(rank, none) == low
            hit &= here
            # of overlapping pairs (aaa) every other one, from the left
            run = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            if len(run):
                begin = np.zeros(len(hit), dtype=np.int64)
                begin[run] = run
                hit &= (np.arange(len(hit)) - np.maximum.accumulate(begin)) % 2 == 0
            to = np.flatnonzero(hit)
            symbols[to] = self.symbols[at[to]]
            stay = here.copy()
            stay[to + 1] = False
            left -= np.bincount(owner[to], minlength=len(left))
            symbols, owner = symbols[stay], owner[stay]
        return left

    def _split(self, chunk: bytes) -> list[bytes]:
        if chunk.isascii():
            return _PRE_ASCII.findall(chunk)
        return [p.encode() for p in _PRE.findall(chunk.decode())]

    def count(self, texts: list[bytes]) -> list[int]:
        whole: list[list[bytes]] = []
        extra = [0] * len(texts)
        for i, raw in enumerate(texts):
            segments = [raw]
            if b"<" in raw and self.special.search(raw.decode()):
                segments = [s.encode() for s in self.special.split(raw.decode())]
                extra[i] = len(segments) - 1
            parts: list[bytes] = []
            for s in segments:
                if not s.isascii() and _WIDE.search(text := s.decode()):
                    parts += [p.encode() for p in _PRE.findall(text)]
                else:
                    parts += _CHUNK.findall(s)
            whole.append(parts)
        known: set[bytes] = set()
        known.update(*whole)
        split = {c: self._split(c) for c in self.chunks.missing(known)}
        needed: set[bytes] = set()
        needed.update(*split.values())
        new = self.parts.missing(needed)
        if new:
            self.parts.update(zip(new, self.merged(new).tolist(), strict=True))
        get = self.parts.__getitem__
        for chunk, parts in split.items():
            self.chunks[chunk] = sum(map(get, parts))
        get = self.chunks.__getitem__
        return [n + sum(map(get, parts)) for n, parts in zip(extra, whole, strict=True)]


def _counting(path: str, text_col: str, names: tuple[str, str]):
    def run(batches):
        counter = held(f"counter {path}", lambda: MergeCounter(path))
        for whole in batches:
            for batch in pieces(whole, text_col):
                data, at = joined(batch.column(text_col))
                raw = data.tobytes()
                counts = counter.count([raw[at[i] : at[i + 1]] for i in range(batch.num_rows)])
                out = batch.append_column(names[0], pa.array(np.diff(at).astype(np.int64)))
                yield out.append_column(names[1], pa.array(counts, pa.int64()))

    return run


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", bytes_as: str = "n_bytes", tokens_as: str = "n_tokens") -> DataFrame:
    """``docs`` with the UTF-8 bytes and the tokens of each text; null and empty texts have none of either. Special
    strings of the tokenizer file are one token each. A column of ``docs`` that has one of the two names is replaced.
    Repeated rows stay; an empty input gives an empty result."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(bytes_as, tokens_as).withColumn(text_col, F.col(text_col).cast("string"))
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema]
    schema = T.StructType([*fields, T.StructField(bytes_as, T.LongType()), T.StructField(tokens_as, T.LongType())])
    return docs.mapInArrow(_counting(tokenizer, text_col, (bytes_as, tokens_as)), schema)

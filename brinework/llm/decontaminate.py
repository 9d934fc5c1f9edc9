"""Benchmark decontamination: a generalised suffix automaton of the normalised test items; documents are streamed
through it word by word, and spans whose matches are long enough are found, reported and removed."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinework.llm.common import bounded_batches, cut, free_name, held, is_word_table, joined, pieces, word_bounds

#: A word is a run of other bytes than these: ASCII controls, space and punctuation.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else 32 if b in SEPARATORS else b for b in range(256))
#: Characters of test items in one automaton; more items are split by a hash of their id.
SHARD_CHARS = 1_000_000

#: What one of several automata gives for a row: flat word spans (start, end, start, ...) and the ids of their items.
HIDDEN = "spans array<int>, items array<string>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


class Automaton:
    """Suffix automaton of all items. ``window_items[s]`` are the items with the window that ends a match in state s."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        seqs = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text or "")]) for name, text in items]
        seqs = [(name, seq) for name, seq in seqs if seq]
        ends = []
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
            ends.append(last)
        self.shortest = min([window, *(len(seq) for _, seq in seqs)]) if seqs else 1 << 30
        n = len(self.link)
        order = sorted(range(1, n), key=self.length.__getitem__)
        #: The suffix of a match in state s that is one window long belongs to state window_state[s].
        self.window_state = [-1] * n
        for s in order:
            if self.length[s] >= window:
                self.window_state[s] = s if self.length[self.link[s]] < window else self.window_state[self.link[s]]
        self.window_items: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str | None]]] = {}
        for (name, seq), end in zip(seqs, ends, strict=True):
            if len(seq) < window:
                whole.setdefault(end, []).append((len(seq), name))
                continue
            state, length = 0, 0
            for c in seq:
                state, length = self.next[state][c], length + 1
                if length >= window and name is not None:
                    self.window_items.setdefault(self.window_state[state], set()).add(name)
        #: Items shorter than a window that end a match in state s, as (words, item).
        self.short_items: dict[int, list[tuple[int, str | None]]] = {}
        for s in order:
            if own := whole.get(s, []) + self.short_items.get(self.link[s], []):
                self.short_items[s] = own

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state({}, -1, length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, nxt: dict, link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans (end exclusive) of all window occurrences, and the items they are from."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        states: set[int] = set()
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short_items
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:  # a word of no item ends every match
                continue
            state, n = 0, 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                step = nxt[state].get(c)
                while step is None and state:
                    state = link[state]
                    n = length[state]
                    step = nxt[state].get(c)
                if step is None:
                    continue
                state, n = step, n + 1
                if n >= window:
                    states.add(state)
                    _grow(spans, i - n, i)
                if state in short:
                    for size, item in short[state]:
                        if size <= n:
                            _grow(spans, i - size, i)
                            if item is not None:
                                items.add(item)
        for s in states:
            items |= self.window_items.get(self.window_state[s], set())
        return spans, items


def _grow(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Add a span whose end is not before any other's, merging what touches or overlaps."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append((start, end))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` less the bytes from the first to the last word of each span; what stays is joined by a space."""
    raw = text.encode()
    starts, ends, _ = word_bounds(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), is_word_table(SEPARATORS))
    left, at = [], 0
    for a, b in spans:
        left.append(raw[at : starts[a]].rstrip(b" "))
        at = int(ends[b - 1])
    left.append(raw[at:].lstrip(b" "))
    return b" ".join(x for x in left if x).decode()


def _with_spans(shard, key: str, window: int, text_col: str, finish):
    """Batches with what ``finish`` makes of each piece and, for each of its rows, the merged word spans that one
    automaton finds, their items and the count of words."""

    def run(batches):
        machine = held(key, lambda: Automaton(shard.value, window))
        for whole in batches:
            for batch in pieces(whole, text_col):
                data, at = joined(batch.column(text_col))
                raw = data.tobytes().translate(_NORMAL)
                found = []
                for i in range(batch.num_rows):
                    words = raw[at[i] : at[i + 1]].split()
                    found.append((*machine.scan(words), len(words)))
                yield finish(batch, found)

    return run


def _spread(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id: str, item_text: str, window: int, shard_chars: int, finish, schema) -> DataFrame:
    """``finish(batch, found)`` of all rows of ``docs``, where ``found`` has (spans, items, words) for each row.

    Items meet in automata of at most about ``shard_chars`` characters each, so what is broadcast and held stays bounded
    however many items there are. With one automaton all is one pass over the texts. With more, the rows are numbered
    and written once; each automaton reads the texts and gives only the rows that it finds something in, and what they
    all found is joined to the rows by their numbers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_chars))

    def machine(k: int):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k) if shards > 1 else items
        return spark.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()]), uuid.uuid4().hex

    if shards == 1:
        return docs.mapInArrow(_with_spans(*machine(0), window, text_col, finish), schema)
    row, hidden = free_name(docs, "_row"), free_name(docs, "_found")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow = numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    parts = [cut(narrow.mapInArrow(_with_spans(*machine(k), window, "text", _hits), f"row long, {HIDDEN}")) for k in range(shards)]
    merged = reduce(DataFrame.union, parts).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    both = numbered.join(merged.select(F.col("row").alias(row), F.struct("spans", "items").alias(hidden)), row, "left")

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text_col):
                found = []
                for text, f in zip(batch.column(text_col).to_pylist(), batch.column(hidden).to_pylist(), strict=True):
                    flat = f["spans"] if f else []
                    found.append((_merged(list(zip(flat[::2], flat[1::2], strict=True))), set(f["items"]) if f else set(), len(words_of(text or ""))))
                yield finish(batch.drop_columns([row, hidden]), found)

    return both.select(*docs.columns, row, hidden).mapInArrow(run, schema)


def _hits(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    """The rows of ``batch`` (row, text) in which something was found."""
    at = [i for i, f in enumerate(found) if f[0]]
    spans = [[x for s in found[i][0] for x in s] for i in at]
    return pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(found[i][1]) for i in at], pa.list_(pa.string()))], names=["row", "spans", "items"])


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(id_col, n_words, n_hit, items) for each row; n_hit: words inside any window of an item; items: their ids, in
    order. A null or wordless text has no words. Null or wordless items match nothing; an item with a null id matches
    but is not listed. Repeated rows stay, other columns are ignored, an empty input gives an empty result."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType

    def finish(batch, found):
        hit = [sum(b - a for a, b in spans) for spans, _, _ in found]
        cols = [batch.column("id"), pa.array([n for _, _, n in found], pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(items) for _, items, _ in found], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "n_hit", "items"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])
    return _spread(narrow, benchmark, "text", item_id, item_text, window, shard_chars, finish, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_coverage: float = 0.5, min_span: int = 1, item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``docs`` less the contaminated spans: a span of at least ``min_span`` words is cut from its text, and a row
    whose cut words are more than ``max_coverage`` of its words goes. Rows without a match stay as they are, empty and
    null texts too; columns are those of ``docs``, whatever their names. Items as in ``report``."""

    def finish(batch, found):
        texts = batch.column(text_col)
        changed, keep = {}, []
        for i, (spans, _, words) in enumerate(found):
            spans = [(a, b) for a, b in spans if b - a >= min_span]
            keep.append(sum(b - a for a, b in spans) <= max_coverage * words)
            if spans and keep[-1]:
                changed[i] = without(texts[i].as_py(), spans)
        if changed:
            at = batch.schema.get_field_index(text_col)
            new = pa.array([changed[i] if i in changed else t.as_py() for i, t in enumerate(texts)], type=batch.schema.field(at).type)
            batch = batch.set_column(at, batch.schema.field(at), new)
        return batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return _spread(docs, benchmark, text_col, item_id, item_text, window, shard_chars, finish, schema)

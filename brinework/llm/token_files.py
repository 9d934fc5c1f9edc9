"""Token-id files: ids ranked by frequency, in byte-aligned variable-length coding with the control bytes apart from
the data bytes, decoded by numpy table lookup.

A file is a Parquet folder of blocks, so that Spark's committers, and not the tasks, put it in place on any store. A
block holds the ids of consecutive documents in ascending id order: ``ranks`` lists the token ids of the block from the
most frequent on; an id is written as its place in that list, in 1 to 4 bytes, least significant first; ``control``
has the length less one of four ids in each byte, from the low bits up; ``data`` has the bytes."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinework.llm.common import bounded_batches, checkpoint_dir, held, pieces
from brinework.llm.word_ids import WordEncoder

#: Ids in a block, about; a longer document is a block by itself. It bounds what a task holds at once.
BLOCK_IDS = 1_000_000

BLOCK = "part int, block int, ids_before long, n_ids long, doc_ids array<long>, doc_sizes array<long>, ranks binary, control binary, data binary"

#: Lengths of the four ids of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    codes[: len(v)] = size - 1
    control = codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    wide = v.view(np.uint8).reshape(-1, 4)
    data = np.empty(int(size.sum(dtype=np.int64)), dtype=np.uint8)
    for k, which, at in _places(size):
        data[at] = wide[which, k]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    wide, data = np.zeros((n, 4), dtype=np.uint8), np.frombuffer(data, dtype=np.uint8)
    for k, which, at in _places(size):
        wide[which, k] = data[at]
    return wide.reshape(-1).view("<u4")


def _places(size: np.ndarray):
    """For each byte of a value: its number, the values that have it, and where it is in the data."""
    first = np.cumsum(size, dtype=np.int64) - size
    yield 0, slice(None), first
    for k in range(1, 4):
        which = np.flatnonzero(size > k)
        yield k, which, first[which] + k


def _block(part: int, number: int, before: int, names: list, texts: list[bytes]) -> dict:
    ids = np.frombuffer(b"".join(texts), dtype="<u4")
    counts = np.bincount(ids)
    tokens = np.flatnonzero(counts)
    ranked = tokens[np.lexsort((tokens, -counts[tokens]))]
    rank = np.zeros(len(counts), dtype=np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    control, data = pack(rank[ids])
    return {"part": part, "block": number, "ids_before": before, "n_ids": len(ids), "doc_ids": names, "doc_sizes": [len(t) // 4 for t in texts], "ranks": ranked.astype("<u4").tobytes(), "control": control, "data": data}


def _writer(path: str, end_id: int, block_ids: int):
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("ranks", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])

    def run(batches):
        encoder = held(f"encoder {path}", lambda: WordEncoder(path))
        part, number, before, n_ids, names, texts = TaskContext.get().partitionId(), 0, 0, 0, [], []
        for whole in batches:
            for batch in pieces(whole, "text"):
                raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
                for name, ids in zip(batch.column("id").to_pylist(), encoder.encode(raw), strict=True):
                    names.append(name)
                    texts.append(ids + end)
                    n_ids += len(ids) // 4 + 1
                    if n_ids >= block_ids:
                        yield pa.RecordBatch.from_pylist([_block(part, number, before, names, texts)], schema)
                        number, before, n_ids, names, texts = number + 1, before + n_ids, 0, [], []
        if names:
            yield pa.RecordBatch.from_pylist([_block(part, number, before, names, texts)], schema)

    return run


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending ``id_col`` order. Null texts are empty;
    null ids come first; rows with one id are ordered by text. ``tokenizer`` is a file of the tokenizers library whose
    pre-tokens never hold white space. An empty input gives an empty file."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    rows.mapInArrow(_writer(tokenizer, end_id, block_ids), BLOCK).write.mode("overwrite").parquet(path)


def _reader(as_ids: bool):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                b = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                ids = np.frombuffer(b["ranks"], dtype="<u4")[unpack(b["control"], b["data"], b["n_ids"])]
                at = np.concatenate([[0], np.cumsum(b["doc_sizes"])]).astype(np.int64)
                cols = [pa.array(b["doc_ids"], pa.int64()), pa.array(at[:-1] + b["ids_before"] + b["base"]), pa.array(np.diff(at))]
                if as_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
                else:
                    raw = ids.astype("<u4").tobytes()
                    cols.append(pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids" if as_ids else "ids_crc32"])

    return run


def read(spark: SparkSession, path: str, as_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files at ``path``, or its ids. ``start`` counts the
    ids of all documents before it: within its part from the block, before the part from one row a part, which is what
    is broadcast."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return blocks.drop("block").join(F.broadcast(base), "part").mapInArrow(_reader(as_ids), "doc_id long, start long, n_tokens long, " + ("ids array<long>" if as_ids else "ids_crc32 long"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

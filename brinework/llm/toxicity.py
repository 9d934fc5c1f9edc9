"""Toxicity by subword-bag embeddings: the vectors of a word's character n-grams are averaged, words are averaged in a
short window, and a linear softmax reads the window; embeddings and softmax are trained jointly in numpy.

A document is as toxic as its worst window, so a few words in a long text count as they do in a short one. Unseen
misspellings share the n-gram vectors of the words they come from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinework.llm.common import bounded_batches, collect_garbage, free_name, pieces, release, trim, word_hashes
from brinework.llm.decontaminate import _NORMAL

BUCKETS, WIDTH, GRAMS, WINDOW = 1 << 16, 8, (3, 4, 5), 8
#: Bytes of text that are scored at once.
PIECE_BYTES = 500_000
#: Distinct words, and words of the texts, that a step of the fit takes at once: they bound its arrays, not what is read.
WORDS, TOKENS = 4096, 65_536
#: Labelled rows of class 0 and of class 1 the model is fitted on, at most; chosen by a hash of the id.
FIT_ROWS = (2400, 800)


@dataclass(frozen=True)
class Model:
    """``table``: what each n-gram bucket adds to the logit of class 1 against class 0; a multiple of 2**-20, so that
    sums of it are exact in any order. ``bias``: the difference of the biases."""

    table: np.ndarray
    bias: float


def _gram_buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the ``n`` bytes from each position of ``data`` on."""
    m = max(len(data) - n + 1, 0)
    h = np.full(m, 0x811C9DC5 + n, dtype=np.uint32)
    for i in range(n):
        h = (h ^ data[i : i + m].astype(np.uint32)) * np.uint32(16777619)
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array with a space between and spaces around, the starts and ends of words, and for each text the
    index of its first word, with the count of words appended."""
    data = np.frombuffer((b" " + b" ".join(t.translate(_NORMAL) for t in texts) + b" " * max(GRAMS)), dtype=np.uint8)
    w = data != 32
    edge = np.flatnonzero(w[1:] != w[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    rows = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) + 1
    return data, starts, ends, np.searchsorted(starts, rows)


def word_scores(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the table over the n-grams of each word and the word itself, and each text's first word."""
    data, starts, ends, first = _laid_out(texts)
    total = model.table[(word_hashes(data, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64)]
    count = np.ones(len(starts))
    for n in GRAMS:
        sums = np.concatenate([[0.0], np.cumsum(model.table[_gram_buckets(data, n)])])
        to = np.maximum(ends + 2 - n, starts - 1)
        total = total + sums[to] - sums[starts - 1]
        count += to - starts + 1
    return total / count, first


def worst_windows(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the largest mean over ``WINDOW`` words on end; a shorter text is filled up with words of score 0."""
    out = np.zeros(len(first) - 1)
    for i in range(len(out)):
        own = scores[first[i] : first[i + 1]]
        if len(own) > WINDOW:
            sums = np.cumsum(own)
            sums[WINDOW:] -= sums[:-WINDOW].copy()
            out[i] = sums[WINDOW - 1 :].max() / WINDOW
        elif len(own):
            out[i] = own.sum() / WINDOW
    return out


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    words, first = word_scores(texts, model)
    return 1 / (1 + np.exp(-np.clip(worst_windows(words, first) + model.bias, -500, 500)))


def _word_buckets(hashes: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word and those of its n-grams, word after word, and how many each word has."""
    data, s, e, _ = _laid_out([b" ".join(words)])
    buckets, owner = [(hashes & np.uint64(BUCKETS - 1)).astype(np.int32)], [np.arange(len(words))]
    for n in GRAMS:
        have = np.maximum(e - s + 3 - n, 0)
        at = np.repeat(s - 1, have) + np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have)
        buckets.append(_gram_buckets(data, n)[at].astype(np.int32))
        owner.append(np.repeat(np.arange(len(words)), have))
    owner = np.concatenate(owner)
    return np.concatenate(buckets)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def _adam(param: np.ndarray, grad: np.ndarray, m: np.ndarray, v: np.ndarray, rate: float, step: int) -> None:
    """One step of Adam, in place."""
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def fit(texts: list[bytes], labels: list[int], steps: int = 120, rate: float = 0.05, decay: float = 1e-7, seed: int = 11) -> Model:
    """Joint training of n-gram vectors and softmax by Adam on the worst window of each text. Without rows of both
    classes, a model that gives every text the one class there is, nearly surely; that of no toxicity for no rows."""
    y = np.asarray(labels, dtype=np.float64)
    texts = [t or b"" for t in texts]
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 20.0 if labels and labels[0] else -20.0)
    # the distinct words, a few texts at a time
    spelled: dict[int, bytes] = {}
    hashes, counts = [], []
    part = np.cumsum([len(t) for t in texts]) // PIECE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for at, to in zip(edges[:-1], edges[1:], strict=True):
        data, starts, ends, first = _laid_out(texts[at:to])
        h = word_hashes(data, starts, ends)
        new, place = np.unique(h, return_index=True)
        raw = data.tobytes()
        spelled.update((k, raw[starts[i] : ends[i]]) for k, i in zip(new.tolist(), place.tolist(), strict=True) if k not in spelled)
        hashes.append(h)
        counts.append(np.diff(first))
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    word = np.sort(np.fromiter(spelled, dtype=np.uint64, count=len(spelled)))
    token = np.empty(first[-1], dtype=np.int32)
    done = 0
    for i, h in enumerate(hashes):
        token[done : done + len(h)] = np.searchsorted(word, h)
        done, hashes[i] = done + len(h), None
    # the buckets of each, word after word
    buckets, size = [], np.zeros(len(word))
    blocks = [(at, min(at + WORDS, len(word))) for at in range(0, len(word), WORDS)]
    for lo, hi in blocks:
        bucket, own = _word_buckets(word[lo:hi], [spelled[k] for k in word[lo:hi].tolist()])
        buckets.append(bucket)
        size[lo:hi] = own
    buckets = np.concatenate([np.zeros(0, np.int32), *buckets])
    begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    del hashes, spelled

    full = np.flatnonzero(np.diff(first))
    y = y[full]
    share = 1 / max(1, len(y))
    lo, hi = first[:-1][full], first[1:][full]
    wide = np.minimum(WINDOW, hi - lo)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    soft, bias = rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, soft, bias)]
    score, sums = np.empty(len(word)), np.empty(len(token) + 1)
    for step in range(1, steps + 1):
        u = soft[:, 1] - soft[:, 0]
        t = emb @ u
        for i, j in blocks:
            score[i:j] = np.add.reduceat(t[buckets[begin[i] : begin[j]]], begin[i:j] - begin[i]) / size[i:j]
        sums[0] = 0.0
        for i in range(0, len(token), TOKENS):
            sums[i + 1 : i + 1 + TOKENS] = score[token[i : i + TOKENS]]
        np.cumsum(sums, out=sums)
        chosen = lo.copy()
        if step <= steps // 4:  # the mean over all words finds what sets the classes apart
            till, parts, scale = hi, hi - lo, 8.0
        else:
            for i in range(len(full)):
                ends_at = sums[lo[i] + wide[i] : hi[i] + 1]
                chosen[i] += np.argmax(ends_at - sums[lo[i] : lo[i] + len(ends_at)])
            till, parts, scale = chosen + wide, WINDOW, 1.0
        logit = (sums[till] - sums[chosen]) / parts * scale + bias[1] - bias[0]
        p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        g = (p - y) * share
        per = g / parts * scale
        flow = sums  # the sums of this step are done with
        flow[:] = 0.0
        np.add.at(flow, chosen, per)
        np.add.at(flow, till, -per)
        np.cumsum(flow, out=flow)
        g_word = np.zeros(len(word))
        for i in range(0, len(token), TOKENS):
            own = token[i : i + TOKENS]
            np.add.at(g_word, own, flow[i : i + len(own)])
        g_word /= size
        g_word[np.abs(g_word) <= 1e-15] = 0.0
        g_bucket = np.zeros(BUCKETS)
        for i, j in blocks:
            np.add.at(g_bucket, buckets[begin[i] : begin[j]], np.repeat(g_word[i:j], size[i:j].astype(np.int64)))
        g_u = emb.T @ g_bucket
        for i in range(0, BUCKETS, WORDS):
            at = slice(i, i + WORDS)
            _adam(emb[at], g_bucket[at, None] * u + decay * emb[at], state[0][0][at], state[0][1][at], rate, step)
        _adam(soft, np.stack([-g_u, g_u], axis=1) + 1e-5 * soft, *state[1], rate, step)
        _adam(bias, np.array([-g.sum(), g.sum()]), *state[2], rate, step)
    table = np.clip(emb @ (soft[:, 1] - soft[:, 0]), -500, 500)
    return Model(np.round(table * 2**20) / 2**20, float(bias[1] - bias[0]))


def fit_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: tuple[int, int] = FIT_ROWS) -> list[tuple[bytes, int]]:
    """At most ``per_class`` rows of label 0 and of label 1 whose crc32(id as text) mod 5 is not 0, least hash first. The
    ids are chosen before any text is read, so only bounded rows meet on the driver. An id with both labels is toxic;
    null ids and labels are left out, and so are null texts. An id with several texts gives all of them."""
    lab = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    lab = lab.groupBy("_id").agg(F.max("_y").alias("_y"))
    lab = lab.where(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0).join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi").withColumn("_h", F.xxhash64("_id"))
    few = [r for y in (0, 1) for r in lab.where(F.col("_y") == y).orderBy("_h", "_id").limit(per_class[y]).collect()]
    if not few:
        return []
    chosen = docs.sparkSession.createDataFrame(pa.table({"_id": pa.array([r["_id"] for r in few], pa.int64()), "_y": pa.array([r["_y"] for r in few], pa.int32())}))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_t")).where("_t is not null")
    got = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_y", "_t").collect()
    return [(r["_t"].encode(), r["_y"]) for r in sorted(got, key=lambda r: (r["_id"], r["_t"]))]


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """The model of ``fit_rows``. The driver collects its garbage before the fit, which is when it needs most memory, and
    what the fit took is given back."""
    rows = fit_rows(docs, labels, id_col, text_col, **options)
    collect_garbage(docs.sparkSession)
    trim()
    model = fit([t for t, _ in rows], [y for _, y in rows])
    del rows
    trim()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_as: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; empty, wordless and null texts have the score of the bias alone. A
    column of ``docs`` with the name of the score is replaced."""
    docs = docs.drop(score_as)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + [T.StructField(score_as, T.DoubleType())])

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text_col, PIECE_BYTES):
                texts = [(t or "").encode() for t in batch.column(text_col).to_pylist()]
                yield batch.append_column(score_as, pa.array(scores(texts, shared.value)))
        release()

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` less the rows that a model fitted on ``labels`` scores at ``threshold`` or more; columns stay, whatever
    their names."""
    model = fitted(docs, labels, id_col, text_col, **options)
    name = free_name(docs, "_toxicity")
    return score(docs, model, text_col, name).where(F.col(name) < threshold).select(*docs.columns)

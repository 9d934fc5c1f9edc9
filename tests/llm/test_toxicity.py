import random
import tracemalloc

import numpy as np

from brinework.llm import common
from brinework.llm import toxicity as x


def some(seed, n):
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ri", "tu", "mel", "san", "dor", "vi"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    bad = ["xenfool", "grimdolt", "zapwretch"]
    out = []
    for _ in range(n):
        toxic = rng.random() < 0.3
        words = [word() for _ in range(rng.choice([5, 40, 300]))]
        for _ in range(rng.randint(1, 4) if toxic else 0):
            w = rng.choice(bad)
            if rng.random() < 0.3:  # a misspelling
                k = rng.randrange(3, len(w))
                w = w[:k] + rng.choice("aeiou") + w[k + 1 :]
            words[rng.randrange(len(words))] = w
        out.append((" ".join(words), int(toxic)))
    return out


def test_held_out_accuracy():
    train, test = some(1, 500), some(2, 400)
    model = x.fit([t.encode() for t, _ in train], [y for _, y in train])
    p = x.scores([t.encode() for t, _ in test], model)
    y = np.array([y for _, y in test])
    assert ((p >= 0.5) == (y == 1)).mean() > 0.95


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    model = x.Model(np.round(rng.normal(size=x.BUCKETS) * 2**20) / 2**20, 0.5)
    texts = [t.encode() for t, _ in some(3, 60)] + [b"", b" . ", b"a", "é ß".encode()]
    whole = x.scores(texts, model)
    assert whole.tolist() == [float(x.scores([t], model)[0]) for t in texts]
    assert whole[60] == whole[61] == 1 / (1 + np.exp(-0.5))


def test_word_scores_as_a_loop():
    rng = np.random.default_rng(2)
    model = x.Model(np.round(rng.normal(size=x.BUCKETS) * 2**20) / 2**20, 0.0)
    text = b"Ab, cde-fgh i"
    got, first = x.word_scores([text, b"", b"ab"], model)
    assert first.tolist() == [0, 4, 4, 5]
    for word, score in zip([b"ab", b"cde", b"fgh", b"i", b"ab"], got, strict=True):
        padded = b" " + word + b" "
        parts = [padded[i : i + n] for n in x.GRAMS for i in range(len(padded) - n + 1)]
        values = [model.table[x._gram_buckets(np.frombuffer(p, dtype=np.uint8), len(p))[0]] for p in parts]
        alone = x.word_hashes(np.frombuffer(word, dtype=np.uint8), np.array([0]), np.array([len(word)]))[0] & np.uint64(x.BUCKETS - 1)
        assert score == (sum(values) + model.table[int(alone)]) / (len(values) + 1)


def test_frames(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(some(4, 300))]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(None, None, None), (9000, "", "s"), (9001, "ba " * 100_000 + "xenfool grimdolt", "s"), (0, rows[0][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (9000, None, 0)], "doc_id long, toxic int, quality int")
    got = x.fit_rows(docs, labels)
    assert 150 < len(got) < 301
    left = x.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    kept = {r.doc_id for r in left.collect()}
    assert {None, 9000} <= kept and 9001 not in kept
    wrong = sum((i in kept) == (y == 1) for i, _, y in rows)
    assert wrong < 15
    few = x.fit([], [])
    assert x.score(docs.limit(0), few).count() == 0 and x.fit([b"a"], [1]).bias > 0 > few.bias


def test_clashing_columns_and_repeated_labels(spark):
    rows = some(4, 120)
    docs = spark.createDataFrame([(i, t, i, "s") for i, (t, _) in enumerate(rows)], "doc_id long, text string, _toxicity long, _id string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] * 2 + [(1, 0), (1, 1), (2, None)], "doc_id long, toxic int")
    got = x.fit_rows(docs, labels)
    assert len(got) == len({t for t, _ in got}) and [y for t, y in got if t == rows[1][0].encode()] in ([], [1])
    left = x.drop_toxic(docs, labels)
    assert left.columns == docs.columns and all(r._toxicity == r.doc_id and r._id == "s" for r in left.collect())


def test_no_rows_mean_no_toxicity():
    assert (x.scores([b"", b"a b"], x.fit([], [])) < 1e-6).all() and (x.scores([b""], x.fit([b"a"], [1])) > 1 - 1e-6).all()


def test_query_columns(spark):
    from brinework.llm.queries import op10_toxicity

    import zlib

    got = op10_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert {f for f in got[0].asDict()} == {"doc_id", "held_out", "score", "predicted"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_worst_windows_as_a_loop():
    rng = np.random.default_rng(5)
    scores = rng.normal(size=60)
    first = np.array([0, 0, 3, 11, 19, 60])
    got = x.worst_windows(scores, first)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        own = list(scores[a:b]) + [0.0] * max(0, x.WINDOW - (b - a))
        assert got[i] == (0.0 if a == b else max(sum(own[k : k + x.WINDOW]) / x.WINDOW for k in range(len(own) - x.WINDOW + 1))) or abs(got[i] - max(sum(own[k : k + x.WINDOW]) / x.WINDOW for k in range(len(own) - x.WINDOW + 1))) < 1e-12


def test_fit_in_blocks(monkeypatch):
    rows = some(6, 120)
    texts, y = [t.encode() for t, _ in rows], [y for _, y in rows]
    whole = x.fit(texts, y, steps=8)
    monkeypatch.setattr(x, "WORDS", 64)
    monkeypatch.setattr(x, "TOKENS", 1000)
    parts = x.fit(texts, y, steps=8)
    assert parts.table.tolist() == whole.table.tolist() and parts.bias == whole.bias
    assert np.isfinite(x.fit([b"", b" "], [0, 1], steps=2).table).all()


def test_memory_of_the_fit():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnop", k=12)) for _ in range(30_000)]
    texts = [" ".join(rng.choices(words, k=200)).encode() for _ in range(1000)]
    tracemalloc.start()
    x.fit(texts, [i % 2 for i in range(1000)], steps=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 45e6, most


def test_native_memory_of_the_driver(spark):
    assert "Trim native heap" in common.trim_jvm(spark)

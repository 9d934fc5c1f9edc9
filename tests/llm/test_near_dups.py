import random

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from brinework.llm import near_dups
from brinework.llm.common import connected_components, joined
import pyarrow as pa


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, n, percent=80):
    sets = {i: near_dups.shingle_set(t, n) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components_of(ids, links)
    return {(i, len(sets[i]), comp[i], comp[i] == i) for i in ids}


def some_docs(seed, groups=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 4)))
    rows, ids = [], iter(rng.sample(range(10_000), 9_000))
    common = [word() for _ in range(60)]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([1, 3, 5, 30, 120]))]
        if rng.random() < 0.4:
            base = base + common
        for _ in range(rng.choice([1, 1, 2, 4, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            rows.append((next(ids), rng.choice([" ", "\n", "  "]).join(own).title()))
    return [*rows, (next(ids), None), (next(ids), ""), (next(ids), " \n ")]


def test_as_all_pairs(spark):
    for seed, n in ((1, 4), (2, 5)):
        rows = some_docs(seed)
        docs = spark.createDataFrame([(t, i, i) for i, t in rows], "text string, doc_id long, kept long").repartition(6)
        got = {tuple(r) for r in near_dups.near_duplicates(docs, shingle=n).collect()}
        assert got == brute(rows, n)


def test_many_near_copies_that_only_the_original_links(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        own = list(base)
        for k in rng.sample(range(0, 200, 12), 4):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_dups.near_duplicates(docs).collect()} == brute(rows, 5)


def test_blocks_of_large_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "FEW", 1)
    monkeypatch.setattr(near_dups, "BLOCK", 7)
    rows = some_docs(9, 25)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_dups.near_duplicates(docs).collect()} == brute(rows, 5)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_dups.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (None, 0, None, True), (3, 0, 3, True)], key=str)
    kept = sorted((r.doc_id for r in near_dups.keep_one(docs).collect()), key=str)
    assert kept == sorted([1, 3, None, None], key=str) and near_dups.keep_one(docs).columns == docs.columns
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0
    assert near_dups.keep_one(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n", max_size=30)), max_size=6), st.integers(1, 5))
def test_shingles_of_joined_rows(texts, n):
    data, at = joined(pa.array(texts, pa.string()))
    got, runs = near_dups.shingle_hashes(data, at, n)
    assert [len(set(got[a:b].tolist())) for a, b in zip(runs[:-1], runs[1:], strict=True)] == [len(near_dups.shingle_set(t, n)) for t in texts]
    alone = [near_dups.shingle_hashes(*joined(pa.array([t], pa.string())), n)[0] for t in texts]
    assert np.array_equal(got, np.concatenate([np.zeros(0, np.uint64), *alone]))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, k) for k in range(1001, 1040)] + [(k, k + 1) for k in range(2000, 2040)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of({x for ab in links for x in ab if ab[0] != ab[1]}, [ab for ab in links if ab[0] != ab[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_id_with_several_texts_is_one_node(spark):
    a, b = "one two three four five six seven", "red orange yellow green blue indigo violet"
    rows = [(5, a), (5, b), (1, a), (2, b), (7, "alone in all the world"), (7, b), (9, a + " eight nine ten eleven"), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.component_id) for r in near_dups.near_duplicates(docs).collect()}
    assert got == {(5, 1), (1, 1), (2, 1), (7, 1), (9, 9), (8, 8)}
    assert sorted(r.doc_id for r in near_dups.keep_one(docs.withColumn("_gone", docs.doc_id)).collect()) == [1, 8, 9]


def test_very_long_texts(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(50_000)}" for _ in range(400_000)]
    near = list(base)
    for k in range(0, 400_000, 10_000):
        near[k] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[: 200_000])), (4, "x " * 600_000), (5, "x " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_dups.near_duplicates(docs).collect()} == brute(rows, 5)


def test_hot_keys(spark, monkeypatch):
    from brinework.llm.common import joined_by_key, with_least

    monkeypatch.setattr("brinework.llm.common.FEW_PAIRS", 10)

    df = spark.range(3000).selectExpr("id", "if(id < 2900, id % 2, id) as k", "(id * 7919) % 3001 as v").repartition(5)
    want: dict[int, int] = {}
    for r in df.collect():
        want[r.k] = min(want.get(r.k, 1 << 40), r.v)
    assert {(r.id, r.least) for r in with_least(df, ["k"], "v", "least", 3000).collect()} == {(r.id, want[r.k]) for r in df.collect()}
    facts = spark.createDataFrame([(0, "a", 1450), (2950, "b", 1)], "k long, fact string, size long")
    got = {(r.id, r.fact) for r in joined_by_key(df, facts, ["k"], "size", 3000, "left").collect()}
    assert got == {(r.id, {0: "a", 2950: "b"}.get(r.k)) for r in df.collect()}

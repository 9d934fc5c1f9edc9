import numpy as np

from brinework.llm import vector_dups as v


def brute(rows, least=0.93):
    good = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        good[i] = (label, np.array(e) / np.linalg.norm(e))
    links = {i: {j for j, (m, y) in good.items() if j != i and m == label and len(x) == len(y) and x @ y >= least} for i, (label, x) in good.items()}
    out = set()
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least_id = None if i is None else min(seen)
        out.add((i, len(links.get(i, ())), least_id, least_id == i if i is not None else True))
    return out


def some(seed, groups=60):
    rng = np.random.default_rng(seed)
    rows, ids = [], iter(rng.permutation(10_000).tolist())
    for _ in range(groups):
        base = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 1, 2, 5, 20]))):
            x = base + rng.normal(size=16) * rng.choice([0, 0.05, 0.1, 0.15])
            rows.append((next(ids), [float(np.float32(y)) for y in x], int(rng.integers(0, 2))))
    return rows


def test_as_all_pairs_over_many_shards(spark):
    rows = some(1)
    schema = "vec_id long, embedding array<float>, label int"
    frame = spark.createDataFrame(rows, schema).repartition(5)
    want = brute(rows)
    got = {tuple(r) for r in v.near_vectors(frame, shard=40).collect()}
    right = sum(min(n, m) for (i, n, *_), (j, m, *_) in zip(sorted(got), sorted(want), strict=True))
    assert right >= 0.97 * sum(n for _, n, *_ in want)
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want), strict=True))
    assert {tuple(r) for r in v.near_vectors(frame).collect()} == want


def test_one_large_group_is_dealt_over_shards(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.02).tolist(), 1) for i in range(300)] + [(1000 + i, base.tolist(), 1) for i in range(50)]
    got = {tuple(r) for r in v.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=60).collect()}
    assert got == {(i, 349, 0, i == 0) for i, *_ in rows}


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [None, 1.0], 1), (9, [float("inf"), 1.0], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.component_id, r.kept) for r in v.near_vectors(frame).collect()}
    assert got == {1: (1, True), 2: (1, False), **{i: (i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)}, None: (None, True)}
    assert v.near_vectors(frame).count() == len(rows)
    assert v.near_vectors(frame.limit(0)).count() == 0


def test_graph_reaches_all():
    x = v.unit(np.random.default_rng(1).normal(size=(300, 8)))
    graph = v.build_graph(x)
    seen, todo = {0}, [0]
    while todo:
        for j in graph[todo.pop()]:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(seen) == 300 and max(map(len, graph)) <= 2 * v.DEGREE + 1


def test_an_id_with_several_vectors_keeps_the_links_of_each(spark):
    rows = [(1, [0.0, 1.0], 1), (5, [0.01, 1.0], 1), (5, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 2), (5, [0.0, 1.0], 2), (4, [-1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in v.near_vectors(frame).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (5, 1, 1), (5, 1, 1), (5, 1, 1)]


def test_clusters_grow_with_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(v, "FIT_VECTORS", 300)
    monkeypatch.setattr(v, "CELL_ROWS", 50)
    monkeypatch.setattr(v, "CELLS", 4)
    rows = some(8, 150)
    frame = spark.createDataFrame([(i, x, 0, "other") for i, x, _ in rows], "vec_id long, embedding array<float>, label int, node string")
    want, audit = brute([(i, x, 0) for i, x, _ in rows]), {}
    got = {tuple(r) for r in v.near_vectors(frame, shard=25, audit=audit).collect()}
    right = sum(min(n, m) for (i, n, *_), (j, m, *_) in zip(sorted(got), sorted(want), strict=True))
    assert right >= 0.97 * sum(n for _, n, *_ in want) and audit["recall"] >= 0.9 and audit["nodes"] > 50
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want), strict=True))


def test_audit_where_links_are_rare(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 24))
    pairs = rng.choice(3000, size=60, replace=False)
    x[3000 + pairs] = x[pairs] + rng.normal(size=(60, 24)) * 0.2  # a cosine of about 0.98
    rows = [(i, v_.tolist(), 1) for i, v_ in enumerate(x)]
    frame, audit = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(8), {}
    got = {r.vec_id: (r.n_links, r.component_id) for r in v.near_vectors(frame, audit=audit).collect()}
    y = v.unit(np.float32(x).astype(np.float64))
    cosine = y @ y.T
    want = (cosine >= 0.93).sum(axis=1) - 1
    found = sum(min(got[i][0], int(n)) for i, n in enumerate(want))
    assert want.sum() >= 110 and found >= 0.93 * want.sum() and all(got[i][0] <= n for i, n in enumerate(want))
    assert audit["recall"] >= 0.9 and audit["links"] >= 100


def test_audit_without_links_is_unmeasured(spark):
    audit = {}
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert {tuple(r) for r in v.near_vectors(frame, audit=audit).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}
    assert audit["recall"] is None and audit["links"] == 0


def test_low_recall_is_no_result(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(v, "_recall", lambda found, true: 0.5)
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError):
        v.near_vectors(frame)

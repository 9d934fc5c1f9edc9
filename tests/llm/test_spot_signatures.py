import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from brinework.llm import queries
from brinework.llm import spot_signatures as s

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def chained(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64(w.encode(), seed=seed).intdigest()
    return seed


def signatures(text, chain=2):
    words = WORD.findall((text or "").lower())
    content = [(i, w) for i, w in enumerate(words) if w not in s.ANCHORS]
    if not content:
        return {chained(["", *words])} if words else set()
    out = {chained(["", *(w for _, w in content[:chain])])}
    for i, w in enumerate(words):
        after = [x for j, x in content if j > i][:chain]
        if w in s.ANCHORS and after:
            out.add(chained([w, *after]))
    return out


def shown(found):
    return "".join(f"{x:016X}" for x in sorted(found, key=lambda x: x - 2**64 if x >= 2**63 else x))


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, half = text or "", len(text or "") // 2
        edited = text[: len(text) - half] + (after or "")[:half]
        own = signatures(text)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(signatures(edited)), round(alike(own, signatures(edited)), 12), round(alike(own, signatures(after)), 12)))
    return sorted(out, key=str)


def digest(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_spot_signatures(spark, str(tmp_path)).collect()
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in found), key=str)


WORDS = "the of and a is red blue green tree house river stone über été 12 x1 \U0001f600".split()


def texts(seed, n, longest=40):
    draw = random.Random(seed)
    return [" ".join(draw.choice(WORDS) for _ in range(draw.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("place_bytes, fan", [(10**8, 64), (700, 64), (150, 3)])
def test_query_as_brute_force(spark, tmp_path, monkeypatch, place_bytes, fan):
    monkeypatch.setattr(s, "PLACE_BYTES", place_bytes)
    monkeypatch.setattr(s, "PLACE_ROWS", place_bytes)
    monkeypatch.setattr(s, "FAN", fan)
    rows = [(7 * i - 50, t) for i, t in enumerate(texts(1, 60))]
    rows += [(1000, None), (1001, ""), (1002, "the of"), (1003, "?!"), (1004, "x"), (1005, "The\nRED, tree; and"), (1006, "the red tree and"), (2**60, "a b"), (None, "red of blue tree"), (None, "of"), (13, "red"), (13, "the blue"), (13, "red")]
    assert digest(spark, rows, tmp_path) == brute(rows)


def test_one_document_long_texts_and_empty(spark, tmp_path):
    assert digest(spark, [(5, "the red tree is blue")], tmp_path / "a") == brute([(5, "the red tree is blue")])
    assert digest(spark, [(None, "of red"), (None, "blue")], tmp_path / "b") == brute([(None, "of red"), (None, "blue")])
    found = digest(spark, [(1, "the red " * 100_000 + "tree"), (2, "é" * 200_000)], tmp_path / "c")
    assert [r[1] for r in found] == [800_004, 200_000] and found[0][3] == shown({chained(["", "red", "red"]), chained(["the", "red", "red"]), chained(["the", "red", "tree"])})
    assert digest(spark, [], tmp_path / "d") == []


def test_likeness_that_sizes_rule_out(spark):
    row = spark.range(1).select(s.likeness(F.expr("array(1L, 2L, 3L)"), F.expr("array(1L)"), 80).alias("a"), s.likeness(F.expr("array(1L, 2L, 3L)"), F.expr("array(1L)")).alias("b"), s.likeness(F.expr("array(1L)"), F.expr("array(1L)"), 80).alias("c")).first()
    assert row.a == 0 and row.b == pytest.approx(1 / 3) and row.c == 1


def classes(rows, percent):
    sets = [(i, signatures(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for i, a in sets:
        for j, b in sets:
            if a and b and None not in (i, j) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {(i, len(a), top(i) if i is not None else None) for i, a in sets}


@pytest.mark.parametrize("seed, percent", [(1, 80), (2, 60), (3, 80)])
def test_near_copies_as_brute_force(spark, seed, percent):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(f"the p{i} q{i}" for i in range(12))
    for i in range(40):
        words = [draw.choice(["the", "of", "is", *vocabulary]) if k % 3 else draw.choice(["the", "of", "is"]) for k in range(draw.randrange(5, 90))]
        for _ in range(draw.choice([1, 1, 2, 5])):
            copy = [draw.choice(vocabulary) if draw.random() < 0.02 else w for w in words]
            rows.append((len(rows), " ".join(copy) + (" " + passage if i % 3 == 0 else "")))
    rows += [(500 + i, rows[0][1]) for i in range(30)] + [(600 + i, passage) for i in range(5)] + [(700, None), (701, ""), (702, "?"), (None, passage), (3, passage)]
    draw.shuffle(rows)
    found = s.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), percent)
    assert {tuple(r)[:3] for r in found.collect()} == classes(rows, percent) and found.count() == len(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.class_id) for r in found.collect())
    assert len({c for _, _, c in classes(rows, percent)}) < len(rows) - 40


def test_near_copies_of_nothing(spark):
    assert s.near_copies(spark.createDataFrame([], "doc_id long, text string, signs string")).count() == 0


def test_no_python_workers(spark, tmp_path):
    spark.createDataFrame([(1, "a red tree")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.op12_spot_signatures(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))

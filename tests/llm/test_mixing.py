import hashlib
import random
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from brinework.llm import mixing


def share(children, amount):
    """Water-filling by exact fractions: name -> (weight, capacity)."""
    left, todo, out = Fraction(amount), dict(children), {}
    while todo:
        w = sum(Fraction(x) for x, _ in todo.values())
        full = [n for n, (x, c) in todo.items() if x > 0 and Fraction(c) * w <= Fraction(x) * left]
        if not full:
            out |= {n: max(0, int(Fraction(x) * left / w)) if w else 0 for n, (x, c) in todo.items()}
            return out
        # the one that is fullest first
        n = min(full, key=lambda n: (Fraction(todo[n][1]) / Fraction(todo[n][0]), n))
        out[n] = todo[n][1]
        left -= todo.pop(n)[1]
    return out


def brute(rows, weights, budget_share, epochs, seed):
    supply = defaultdict(int)
    for _, text, lang, source, domain in rows:
        supply[domain or "", lang or "", source or ""] += len((text or "").split())
    total = int(sum(supply.values()) * budget_share)
    due = {}

    def down(prefix, amount):
        depth = len(prefix)
        if depth == 3:
            due[prefix] = amount
            return
        caps = defaultdict(int)
        for leaf, n in supply.items():
            if leaf[:depth] == prefix:
                caps[leaf[depth]] += n * epochs
        w = weights.get(mixing.LEVELS[depth], {})
        for name, a in share({n: (w.get(n, 1.0), c) for n, c in caps.items()}, amount).items():
            down((*prefix, name), a)

    down((), total)
    out = []
    for leaf, a in due.items():
        whole = a // supply[leaf] if supply[leaf] else 0
        extra = a - whole * supply[leaf]
        groups = defaultdict(list)
        for r in rows:
            if (r[4] or "", r[2] or "", r[3] or "") == leaf:
                name = "" if r[0] is None else str(r[0])
                groups[hashlib.md5(f"{seed}:{whole + 1}:{name}".encode()).hexdigest()].append(r)
        till = 0
        for key in sorted(groups):
            till += sum(len((r[1] or "").split()) for r in groups[key])
            for r in groups[key]:
                out += [(r[0], *leaf, e) for e in range(1, whole + (2 if till <= extra else 1))]
    return sorted(out, key=str)


def some(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 30)), rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice(["web", "web", "books", None])) for i in range(n)]
    return [*rows, rows[0], (None, "x y", "en", "a", "web"), (n, None, "en", "a", "web"), (n + 1, "", "fr", "c", "tiny")]


def test_as_brute_force(spark):
    for seed, part, epochs, weights in ((1, 0.5, 2, {}), (2, 0.9, 1, {"domain": {"books": 5.0}, "source": {"a": 3.0}}), (3, 1.7, 3, {"lang": {"en": 4.0, "de": 0.0}}), (4, 0.0, 2, {}), (5, 9.0, 2, {"domain": {"web": 0.0}})):
        rows = some(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tag string").repartition(4)
        got = mixing.mix(docs, F.col("tag"), part, weights, epochs, seed)
        got = [(r.doc_id, r._domain, r.lang or "", r.source or "", r._epoch) for r in got.collect()]
        assert sorted(got, key=str) == brute(rows, weights, part, epochs, seed)


def test_short_sibling_gives_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d", "en", "small", 10), ("d", "en", "big", 1000), ("d", "de", "other", 1000), ("e", "en", "far", 1000)], "domain string, lang string, source string, supply long")
    due = {(r.domain, r.lang, r.source): r.tokens_due for r in mixing.budgets(leaves, 800, {}, 1).collect()}
    assert due == {("d", "en", "small"): 10, ("d", "en", "big"): 190, ("d", "de", "other"): 200, ("e", "en", "far"): 400}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, tag string")
    assert mixing.mix(docs, F.col("tag")).count() == 0


def test_orders_cut_into_several_levels_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_ROWS", 2)
    monkeypatch.setattr(mixing, "DIGITS", 1)
    assert [mixing._levels(n) for n in (0, 32, 33, 512, 513)] == [1, 1, 2, 2, 3]
    for seed in (6, 7):
        rows = some(seed, 400)
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tag string")
        got = [(r.doc_id, r._domain, r.lang or "", r.source or "", r._epoch) for r in mixing.mix(docs, F.col("tag"), 0.6, {}, 2, seed).collect()]
        assert sorted(got, key=str) == brute(rows, {}, 0.6, 2, seed)


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, "a b c", "en", "s", "web", "mine", 7), (2, "w " * 500_000, "en", "s", "web", "mine", 7), (3, None, "en", "s", "web", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tag string, _tokens string, _mix_key int")
    got = mixing.mix(docs, F.col("tag"), 1.0, max_epochs=1, tokens_as="n")
    assert got.columns == ["doc_id", "text", "lang", "source", "tag", "_tokens", "_mix_key", "_domain", "n", "_epoch"]
    assert {(r.doc_id, r._tokens, r._mix_key, r.n) for r in got.collect()} == {(1, "mine", 7, 3), (2, "mine", 7, 500_000), (3, None, None, 0)}
    replaced = mixing.mix(docs, F.col("tag"), 1.0, max_epochs=1)
    assert replaced.columns.count("_tokens") == 1 and {r._tokens for r in replaced.collect()} == {3, 500_000, 0}

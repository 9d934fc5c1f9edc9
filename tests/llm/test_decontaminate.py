import random
import re

from brinework.llm import decontaminate as d


def brute(text, items, window):
    words = d.words_of(text or "")
    hit, found = set(), set()
    for name, item in items:
        own = d.words_of(item or "")
        if not own:
            continue
        k = min(window, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                if name is not None:
                    found.add(name)
    return len(words), len(hit), sorted(found)


def cases(seed):
    rng = random.Random(seed)
    draw = lambda n, k: " ".join(rng.choice("abcdefg"[:k]) for _ in range(n))
    items = [(str(i), draw(rng.choice([1, 2, 3, 5, 9, 14]), rng.choice([2, 3, 7]))) for i in range(8)]
    items += [("9", None), ("10", " .,"), (None, "a b c"), items[0]]
    texts = [draw(rng.choice([0, 1, 4, 30, 200]), rng.choice([2, 3, 7])) for _ in range(40)]
    return items, [*texts, None, "", "A, b; a-a!\x00b_c"]


def test_words():
    assert d.words_of("Ab-c É9\x7f~z") == [b"ab", b"c", "É9".encode(), b"z"]
    assert [w.decode() for w in d.words_of("aB1é.ñ_x")] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ab1é.ñ_x")


def test_automaton_as_all_windows():
    for seed in range(60):
        items, texts = cases(seed)
        for window in (2, 3, 5):
            machine = d.Automaton(items, window)
            for t in texts:
                spans, found = machine.scan(d.words_of(t or ""))
                assert (sum(b - a for a, b in spans), sorted(found)) == brute(t, items, window)[1:]
                assert spans == d._merged(spans)


def test_report_with_one_and_many_automata(spark):
    items, texts = cases(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: brute(t, items, 5) for i, t in enumerate(texts)}
    for size in (1_000_000, 20):
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in d.report(docs, bench, window=5, shard_chars=size).collect()}
        assert got == want


def test_removal(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    keep = "before ... words that stay and a few more of them here to be long enough"
    rows = [(1, f"{keep}. One, two three FOUR five six seven eight nine ten! After.", "x"), (2, "one two three four five six seven eight nine ten", "x"), (3, keep, None), (None, None, None), (4, "", "y"), (5, "é " * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    got = {r.doc_id: r.text for r in d.decontaminate(docs, bench).collect()}
    assert got == {1: f"{keep}. ! After.", 3: keep, None: None, 4: "", 5: "é " * 100_000}
    assert d.decontaminate(docs, bench).columns == docs.columns
    assert d.decontaminate(docs.limit(0), bench).count() == 0 and d.decontaminate(docs, bench.limit(0)).count() == 6

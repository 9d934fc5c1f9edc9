import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from brinework.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + t[h:]  # the sign of a remainder is that of c
    return out


def brute(convs):
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for node, found in members.items():
        under = [v for v in members if v[: len(node)] == node]
        kids = [v for v in under if len(v) == len(node) + 1]
        leaves = [v for v in under if not any(w != v and w[: len(v)] == v for w in under)]
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in under if v)
        ends = ",".join(map(str, sorted(c for c in found if len(convs[c]) == len(node))))
        out.append((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def found(spark, rows, **more):
    return Counter(map(tuple, p.trie(p.rebuilt(spark.createDataFrame(rows, SCHEMA)), **more).collect()))


def chats(seed, convs, words, longest):
    draw = random.Random(seed)
    return [(draw.randrange(3 * convs) if draw.random() < 0.05 else c, draw.choice([t, t, t, None]), draw.choice(["user", "assistant", None]), draw.choice(words)) for c in range(convs) for t in range(draw.randrange(longest))]


@pytest.mark.parametrize("seed, convs, words, longest, turns", [(1, 60, ["a", "bé", "", None], 6, 10**6), (2, 60, ["a", "b"], 12, 7), (3, 80, ["a"], 14, 5), (4, 50, list("abcdefgh"), 4, 3), (5, 40, ["x"], 30, 40), (6, 90, ["a", "b"], 3, 1)])
def test_as_brute_force(spark, seed, convs, words, longest, turns):
    rows = chats(seed, convs, words, longest)
    assert found(spark, rows, block_turns=turns) == brute(rebuilt(rows))


def test_turnless_members_and_single_ones(spark):
    one = [(1, 0, "user", "hi")]  # crc32 of "1" takes more turns than there are, and 0 is absent
    assert found(spark, one) == brute(rebuilt(one)) and rebuilt(one) == {1: []}
    rows = [(c, t, "user", "x") for c in (1, 2, 3, 4, 6, 7, 8) for t in range(3)] + [(None, 0, "user", "x")]
    assert any(not t for t in rebuilt(rows).values())
    assert found(spark, rows) == brute(rebuilt(rows)) and found(spark, rows, block_turns=2) == brute(rebuilt(rows))


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", f"{t}" if c % 50 else f"{c}") for c in [*range(-20, 3000), 10**12, 10**15 + 1] for t in range(3)]
    want = brute(rebuilt(rows))
    assert found(spark, rows) == want and found(spark, rows, block_turns=300) == want


def test_very_long_conversation(spark):
    rows = [(5, t, "user", "y" * (t % 3)) for t in range(3000)] + [(6, t, "user", "y" * (t % 3)) for t in range(2000)]
    got = found(spark, rows)
    assert sum(got.values()) == len(got) and max(x[1] for x in got) == 3000
    convs = rebuilt(rows)
    same = next((i for i, (a, b) in enumerate(zip(convs[5], convs[6])) if a != b), 2000)
    assert {x[1]: x[3] for x in got if x[3] == 2} == {d: 2 for d in range(same + 1)}


def test_null_columns_other_columns_and_empty(spark):
    df = spark.createDataFrame([(0, None, None, None, 1), (0, None, "user", None, 2), (1, 0, None, "a", 3)], SCHEMA + ", path int")
    rows = [tuple(r)[:4] for r in df.collect()]
    assert Counter(map(tuple, p.trie(p.rebuilt(df)).collect())) == brute(rebuilt(rows))
    assert p.trie(p.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from brinework.llm import pii
from brinework.llm.queries import private_digest

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 1, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab.@-+ 0123456789()_%é", max_size=60))
def test_base_as_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.d", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49", " ", "..", "x", "0000"]), max_size=9))
def test_base_of_joined_pieces(parts):
    assert pii.base_spans("".join(parts)) == plain("".join(parts))


def found(text):
    base, every = pii.all_spans(text)
    assert set(base) <= set(every)
    return [(kind, text[a:b]) for a, b, kind in every if (a, b, kind) not in base]


def test_disguises():
    assert found("mail john.doe (at) example [dot] com now") == [("email", "john.doe (at) example [dot] com")]
    assert found("mail john at example dot co dot uk now") == [("email", "john at example dot co dot uk")]
    assert found("mail jоhn@exаmple.com") == [("email", "jоhn@exаmple.com")]
    assert found("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ") == [("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ")]
    assert found("card four one one one one one one one one one one one one one one one end") == [("card", "four one one one one one one one one one one one one one one one")]
    assert found("call plus four nine one seven zero one two three four five six now") == [("phone", "plus four nine one seven zero one two three four five six")]
    assert found("host one nine two dot one six eight dot one two three dot two two two ok") == [("ip", "one nine two dot one six eight dot one two three dot two two two")]
    assert found("192[.]168[.]0[.]1") == [("ip", "192[.]168[.]0[.]1")]


def test_guards_let_every_rule_through():
    assert found("mail john@example dot com now") == [("email", "john@example dot com")]
    assert found("call +44 two 0 7 five 9 4 6 0 9 5 8 now") == [("phone", "+44 two 0 7 five 9 4 6 0 9 5 8")]
    assert found("tel +33 un 4 un 5 6 7 8 9 0 fin") == [("phone", "+33 un 4 un 5 6 7 8 9 0")]
    assert found("call plus 44 20 7946 0958 now") == [("phone", "plus 44 20 7946 0958")]
    assert found("host 192 dot 168 dot 0 dot 1 ok") == [("ip", "192 dot 168 dot 0 dot 1")]
    assert found("mail john at one two three dot com now") == [("email", "john at one two three dot com")]
    assert found("mail john@example POİNT com now") == [("email", "john@example POİNT com")]


def test_a_base_span_hides_no_disguise_that_it_is_part_of(spark):
    text = "mail jоhn@example.com now"  # a Cyrillic о, which the base pattern stops at
    assert pii.all_spans(text) == ([(7, 21, "email")], [(5, 21, "email"), (7, 21, "email")])
    docs = spark.createDataFrame([(text, 1)], "text string, _spans int")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [("mail <email> now", 1)]
    assert found("card four one one one 1111 1111 1111 end") == [("card", "four one one one 1111 1111 1111")]
    assert found("a@b.cc (at) d.ee") == []


def test_many_spans_take_linear_time():
    import time

    def seconds(n):
        text = "a@b.cc jоhn@example.com " * n
        start = time.perf_counter()
        base, every = pii.all_spans(text)
        assert len(base) == 2 * n and len(every) == 3 * n
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 20 * seconds(2_000) + 1


def test_long_chains_take_linear_time():
    import time

    for part in ("a dot ", "a_dot_", "x at a dot ", "at ", "a.", "a", "1 ", "one ", "@a dot ", "x@y dot a dot ", "a (dot) ", "1.1.", "+1 ", "dot at ", "\t", "x at "):
        text = "x@y dot " + part * (1_000_000 // len(part))
        start = time.perf_counter()
        pii.all_spans(text)
        assert time.perf_counter() - start < 12, part
    labels = " dot ".join(["a"] * 9)
    assert found(f"mail x at {labels} dot com now") == [("email", f"x at {labels} dot com")]


def test_any_last_label_where_the_host_is_sure():
    assert found("mail john at mail dot example dot se now") == [("email", "john at mail dot example dot se")]
    assert found("mail john@example dot museum now") == [("email", "john@example dot museum")]
    assert found("mail john (at) mail dot acme dot in now") == [("email", "john (at) mail dot acme dot in")]
    assert found("mail john_at_example_dot_pl now") == [("email", "john_at_example_dot_pl")]
    assert found("correo juan arroba ejemplo punto mx ya") == [("email", "juan arroba ejemplo punto mx")]
    for text in ["arrive at this point to point link", "look at a dot to dot puzzle", "look at this dot matrix printer", "log in as me@host point your browser there"]:
        assert pii.all_spans(text) == ([], []), text


def test_clean_prose_is_left_alone():
    for text in ["", "one two three and four", "look at the dot on the map", "meet me at noon. point taken", "vier und sieben", "à point nommé", "(at) home", "a at b. dot"]:
        assert pii.all_spans(text) == ([], [])


def test_base_stays_beside_disguises():
    text = "a@b.cc and x (at) y (dot) zz and 10.0.0.1"
    base, every = pii.all_spans(text)
    assert base == plain(text) and len(every) == 3


def test_frames(spark):
    rows = [(1, "a@b.cc", "k"), (1, "a@b.cc", "k"), (None, None, None), (2, "", "x"), (3, "é +12 345 678 90", None), (4, "w " * 200_000 + "a@b.cc", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, r.n_email, r.n_phone, r.spans) for r in private_digest(docs).collect()), key=str)
    assert got == sorted([(1, 1, 0, "email:0:6"), (1, 1, 0, "email:0:6"), (None, 0, 0, ""), (2, 0, 0, ""), (3, 0, 1, "phone:2:16"), (4, 1, 0, "email:400000:400006")], key=str)
    assert private_digest(docs.limit(0)).count() == 0
    red = {r.text for r in pii.redact(docs).collect()}
    assert {"<email>", None, "", "é <phone>"} <= red and pii.redact(docs).columns == docs.columns

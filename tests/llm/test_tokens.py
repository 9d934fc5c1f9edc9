import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brinework.llm import token_files, word_ids
from brinework.llm.token_counts import MergeCounter, token_counts
from brinework.llm.word_ids import Cache, Memo, WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
byte_library, word_library = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
counter, encoder = MergeCounter(BYTE), WordEncoder(WORD)

ODD = ["", " ", "\n", "a", "  a  b ", "it's they'll 'S ''s !'s", "x<|endoftext|>y <|endoftext|>", "aaaaaaaaaaaaa", "\x1c!\x1cq\x1f r", "   x \n y　", "Straße ΣΑΣ İx é é ①½ ٣", "日本語 text", "1234 5 6,7", "\t\r\n\x0b\x0c end \n\n\n", "🙂🙂 a‍b", "<|startoftext|>A<|endoftext|", "ĂăǅǄ ÿŸ×÷"]


def check(texts):
    raw = [t.encode() for t in texts]
    assert counter.count(raw) == [len(byte_library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(raw)] == [word_library.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_texts_as_the_library_has_them():
    check(ODD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdltAazZéÉßñ.,!0189<|>  \x1c"), st.characters(codec="utf-8", max_codepoint=0x2FFF)), max_size=40), max_size=4))
def test_any_text_as_the_library_has_it(texts):
    check(texts)


def test_a_cache_keeps_what_is_used_and_stays_small():
    c = Cache(3)
    for k in range(10):
        for m in c.missing({k, "hot"}):
            c[m] = m
        assert c["hot"] == "hot" and len(c) <= 5


def test_a_stretch_looks_each_pre_token_up_once():
    asked = Counter()

    class Asked(Memo):
        def __getitem__(self, key):
            asked[key] += 1
            return super().__getitem__(key)

    fresh = WordEncoder(WORD)
    fresh.parts, fresh.chunks = Asked(100, fresh._part), Asked(100, fresh._chunk)
    text = "It's the Straße, THE STRASSE! the, The. x7 " * 500
    want = np.array(word_library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert fresh.encode([text.encode()] * 3) == [want] * 3
    assert max(asked.values()) == 1 and sum(asked.values()) == 10, asked


def test_stretches_of_any_length_as_the_library_has_them(monkeypatch):
    texts = [*ODD, " ".join(ODD), "ÀÉÞ× 'RE'll''s 's's 'É 5'd " * 3, "x" * 50 + " 日本—x it's", "", "<|ENDOFTEXT|> <|endoftext|>'s"]
    for n in (1, 2, 7, 40):
        monkeypatch.setattr(word_ids, "STRETCH", n)
        check(texts)
        check(texts[::-1])
    assert encoder.encode([]) == []


def test_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = rng.choice([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], size=n).astype(np.uint32)
        assert token_files.unpack(*token_files.pack(v), n).tolist() == v.tolist()


def test_files_round_trip(spark):
    random.seed(3)
    rows = [(i, random.choice([*ODD, "hello world " * 50]), i % 7) for i in random.sample(range(1000), 60)]
    rows += [(rows[0][0], rows[0][1], 9), (5000, None, 1), (None, "no id", 2), (6000, "long " * 60000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    path = token_files.shared_path(spark, "t")
    token_files.write(docs, path, WORD, block_ids=500)
    got = sorted(token_files.read(spark, path, as_ids=True).collect(), key=lambda r: r.start)
    want = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for g, (i, text) in zip(got, want, strict=True):
        ids = [*word_library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (i, start, len(ids), ids)
        start += len(ids)
    crc = {r.start: r.ids_crc32 for r in token_files.read(spark, path).collect()}
    assert all(crc[g.start] == zlib.crc32(np.array(g.ids, dtype="<u4").tobytes()) for g in got)


def test_empty_files(spark):
    path = token_files.shared_path(spark, "t")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path, WORD)
    assert token_files.read(spark, path).count() == 0


def test_counts_keep_columns_and_rows(spark):
    docs = spark.createDataFrame([(1, "héllo", 5), (1, "héllo", 5), (None, None, None), (2, "", 0)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(docs, BYTE).select("doc_id", "n_bytes", "n_tokens").collect()), key=str)
    n = len(byte_library.encode("héllo").ids)
    assert got == sorted([(1, 6, n), (1, 6, n), (None, 0, 0), (2, 0, 0)], key=str)
    assert token_counts(docs.limit(0), BYTE).count() == 0

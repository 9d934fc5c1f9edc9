import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_mixing import brute as mixed
from test_near_dups import components_of
from tokenizers import Tokenizer

import corpus_pipeline
from brinework.llm import decontaminate, near_dups, toxicity
from brinework.llm.queries import MIX, mix_domain

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
EXTRA = ["_found", "_tokens", "_toxicity", "_gone"]


@pytest.fixture(scope="module")
def docs(spark):
    """The documents with a repeated row, null and empty texts, a null id, null sources, and columns of clashing names."""
    found = spark.read.parquet(f"{DATA}/documents.parquet")
    kinds = found.schema
    odd = spark.createDataFrame([(90_001, None, "en", None, 0), (90_002, "", None, "src1", 0), (None, "no id has this text of ten words or so", "en", "src0", 40), (90_003, "w " * 50_000, "en", "src0", 100_000)], kinds)
    out = found.union(odd).union(found.orderBy("doc_id").limit(1))
    return out.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in EXTRA}).repartition(3).cache()


def kept(out, docs):
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in rows for c in EXTRA)
    return sorted((-1 if r.doc_id is None else r.doc_id for r in rows))


def ids(rows):
    return sorted(-1 if r.doc_id is None else r.doc_id for r in rows)


def test_names():
    assert list(STAGES) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]


def test_toxicity_stage(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fitted(docs, labels)
    want = [r for r in docs.collect() if toxicity.scores([(r.text or "").encode()], model)[0] < 0.5]
    assert kept(STAGES["toxicity"](spark, docs, DATA), docs) == ids(want) and len(want) < docs.count()


def test_near_duplicates_stage(spark, docs):
    rows = docs.where("doc_id is not null").collect()
    sets = {r.doc_id: near_dups.shingle_set(r.text, 5) for r in rows}
    order = sorted(sets)
    links = [(a, b) for i, a in enumerate(order) for b in order[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = components_of(order, links)
    assert links and kept(STAGES["near_duplicates"](spark, docs, DATA), docs) == sorted([-1, *(i for i in order if least[i] == i)])


def test_decontamination_stage(spark, docs):
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = decontaminate.words_of(r.text or "")
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes, want = {len(w) for w in windows}, []
    for r in docs.collect():
        w = decontaminate.words_of(r.text or "")
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if len(hit) <= 0.5 * len(w):
            want.append((-1 if r.doc_id is None else r.doc_id, [x for j, x in enumerate(w) if j not in hit], bool(hit), r.text))
    out = STAGES["decontamination"](spark, docs, DATA)
    assert kept(out, docs) == sorted(x[0] for x in want) and any(x[2] for x in want)
    key = lambda x: (x[0], str(x[1]))
    got = sorted(((-1 if r.doc_id is None else r.doc_id, decontaminate.words_of(r.text or ""), r.text, r.n_chars) for r in out.collect()), key=key)
    for (i, words, text, n), (j, left, cut, old) in zip(got, sorted(want, key=key), strict=True):
        assert (i, words) == (j, left) and (cut or text == old) and n == (None if text is None else len(text))


def test_mixing_stage(spark, docs):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.domain) for r in docs.withColumn("domain", mix_domain()).collect()]
    want = mixed(rows, MIX["weights"], 0.9, 1, MIX["seed"])
    assert kept(STAGES["mixing"](spark, docs, DATA), docs) == sorted(-1 if w[0] is None else w[0] for w in want)


def test_token_ids_stage(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = STAGES["token_ids"](spark, docs, DATA).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    assert [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:]) and got[0].doc_id is None


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, docs, name):
    assert STAGES[name](spark, docs.limit(0), DATA).count() == 0


def test_all_stages_in_order(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    assert out and {f for f in out[0].asDict()} == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_checkpoints_go_as_they_are_passed(spark):
    from brinework.llm import common

    before = common.written(spark)
    with common.swept(spark):
        kept = common.cut(spark.range(10))
        gone = common.cut(spark.range(5))
        assert len(common.written(spark) - before) == 2
        common.passed(gone)
        assert len(common.written(spark) - before) == 1 and kept.count() == 10
    assert common.written(spark) == before
    common.passed(spark.range(3), kept)

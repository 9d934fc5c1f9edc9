import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from brinework.llm import fill_middle as f

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "a", " a\tb\n\nc  ", "x<P>y", "<S>", "<M> b", "<P <S <M", "<<P", "a <\tP> b", "é\U0001f600 ü z w \x1fq\x0b", "ab " * 3000, " " * 200_000, "\n".join("word %d" % i for i in range(50)), "a\0b c", "$1 \\1 \\"]


def test_as_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "one two three four"), (3, "a"), (-5, "one two three"), (2**62, "one two three")]
    df = f.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(map(tuple, df.select("doc_id", "_fim.*").collect()))
    assert got == Counter((i, *brute(i, t)) for i, t in rows)
    assert {k[2] for k in got} == {"plain", "psm", "spm"}


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)]
    df = f.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), seed=7, rate=100, spm=50)
    back = df.select("text", f.restored(F.col("_fim.output"), F.col("_fim.form")).alias("back")).collect()
    assert len(back) == len(rows) and all(r.back == (r.text or "") for r in back)


def test_other_columns_parameters_and_empty(spark):
    rows = [(1, "a b c d", 5, "x", None)]
    df = f.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, _fim int, _fim_units string, extra int"), seed=1, rate=0)
    assert df.columns == ["doc_id", "text", "_fim", "_fim_units", "extra", "_fim_"]
    row = df.first()
    assert row["_fim_"].form == "plain" and row["_fim_"].output == "a b c d" and row["_fim"] == 5 and row["_fim_units"] == "x"
    assert f.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = f.fill_in_middle(spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Pandas", "ArrowEval"))

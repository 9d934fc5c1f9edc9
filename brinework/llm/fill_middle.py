"""Fill-in-middle transformation of documents, in DataFrame functions only: a text is cut into units (a word with the blanks
before it), two cuts drawn from the id split the units into prefix, middle and suffix, and these are put in another order
between sentinels. ``restored`` gives the text back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.llm.common import free_name

#: A unit: a word with the blanks before it, or blanks at the end of the text. The possessive forms match the same and
#: never step back, so a long run of blanks takes linear time.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(seed: int, id_col: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:id``; a null id is the empty name."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. No piece holds a sentinel, so the three of them part the output in one way."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_fim``: a struct of n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points;
    null where plain) and output.

    ``rate`` percent of the ids are transformed, ``spm`` percent of those with the suffix first. A text that is empty or
    holds a sentinel stays plain; a null text is empty. Repeated ids draw the same cuts, each for its own text. Other
    columns stay; where one is named ``_fim``, the new one gets an underscore more. An empty input gives an empty result.
    Every row is worked on by itself: there is no shuffle."""
    text, out = F.coalesce(F.col(text_col).cast("string"), F.lit("")), free_name(docs, "_fim")
    own = {k: free_name(docs, f"_fim_{k}") for k in ("text", "units", "draws", "n", "low", "high", "form", "prefix", "middle", "suffix")}
    col = {k: F.col(v) for k, v in own.items()}
    # each step names what the next uses more than once, so that it is worked out once
    step = docs.withColumns({own["text"]: text, own["units"]: F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), own["draws"]: F.array(*draws(seed, F.col(id_col)))})
    step = step.withColumn(own["n"], F.size(col["units"]).cast("long"))
    cuts = [col["draws"][i] % (col["n"] + 1) for i in (0, 1)]
    plain = (col["text"] == "") | F.col(own["text"]).rlike(f"{PREFIX}|{SUFFIX}|{MIDDLE}") | (col["draws"][2] % 100 >= rate)
    form = F.when(plain, "plain").when(col["draws"][3] % 100 < spm, "spm").otherwise("psm")
    step = step.withColumns({own["low"]: F.least(*cuts).cast("int"), own["high"]: F.greatest(*cuts).cast("int"), own["form"]: form})

    def piece(start: Column, length: Column) -> Column:
        return F.when(col["form"] != "plain", F.array_join(F.slice(col["units"], start, length), ""))

    step = step.withColumns({
        own["prefix"]: piece(F.lit(1), col["low"]),
        own["middle"]: piece(col["low"] + 1, col["high"] - col["low"]),
        own["suffix"]: piece(col["high"] + 1, col["n"].cast("int") - col["high"]),
    })
    psm = F.concat(F.lit(PREFIX), col["prefix"], F.lit(SUFFIX), col["suffix"], F.lit(MIDDLE), col["middle"])
    spm_first = F.concat(F.lit(SUFFIX), col["suffix"], F.lit(PREFIX), col["prefix"], F.lit(MIDDLE), col["middle"])
    output = F.when(col["form"] == "plain", col["text"]).when(col["form"] == "psm", psm).otherwise(spm_first)
    lengths = [F.length(col[k]).cast("long").alias(f"{k}_chars") for k in ("prefix", "middle")]
    return step.select(*docs.columns, F.struct(col["n"].alias("n"), col["form"].alias("form"), *lengths, output.alias("output")).alias(out))


def oracle(seed: int = 42, rate: int = 50, spm: int = 80) -> str:
    """DuckDB SQL of the digest over ``documents``."""
    blank, other = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    number = "CAST(concat('0x', substr(d, {}, 8)) AS BIGINT)"
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
    regexp_extract_all(coalesce(text, ''), '{blank}*{other}+|{blank}+') AS u FROM documents),
h AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, {number.format(1)} % (len(u) + 1) AS a, {number.format(9)} % (len(u) + 1) AS b,
    {number.format(17)} % 100 AS c, {number.format(25)} % 100 AS e FROM t),
f AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= {rate} THEN 'plain'
      WHEN e < {spm} THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(a, b) + 1:n], ''), '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM f
"""

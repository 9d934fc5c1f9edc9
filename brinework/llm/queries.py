"""The queries of the llm operators over the test tables, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from brinework.llm import fill_middle, licences, mixing, pii, prefix_trie, spot_signatures, token_files, tool_calls, toxicity
from brinework.llm.common import table
from brinework.llm.decontaminate import report
from brinework.llm.near_dups import near_duplicates
from brinework.llm.token_counts import token_counts
from brinework.llm.vector_dups import near_vectors

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w WHERE ws IS NOT NULL)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query(_OP3)
def op3_minhash_near_dedup(spark, sf_dir):
    """Contract of op3: shingles of four words, links at 80 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


_OP2 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
k AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, unnest(list_transform(range(1, greatest(2, len(ws) - 8)), lambda i: array_to_string(ws[i:i+9], ' '))) AS win
  FROM b WHERE len(ws) > 0),
d AS (
  SELECT doc_id, kk.k AS k, unnest(range(1, len(ws) - kk.k + 2)) AS i, ws FROM w, (SELECT DISTINCT k FROM k) kk WHERE len(ws) >= kk.k),
m AS (SELECT d.doc_id, d.i, d.k, k.item_id FROM d JOIN k ON k.k = d.k AND k.win = array_to_string(d.ws[d.i:d.i+d.k-1], ' ')),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


@query(_OP2)
def op2_benchmark_decontamination(spark, sf_dir):
    """Contract of op2: windows of ten words over whole documents and items."""
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op4_token_id_files(spark, sf_dir):
    """Contract of op4: word_bpe_49k ids with end id 1, written and read back."""
    path = token_files.shared_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path)


@query()
def op5_token_counts(spark, sf_dir):
    """Contract of op5: byte_bpe_50k tokens, limit 512."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def private_digest(docs):
    """The columns of op6 from the spans that ``pii.find`` gives."""
    found = pii.find(docs.select("doc_id", "text"), spans_as="_all").withColumn("_base", F.filter("_all", lambda s: ~s["disguised"]))

    def count(kind):
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("_all")).alias("spans"))


@query()
def op6_pii_spans(spark, sf_dir):
    """Contract of op6."""
    return private_digest(table(spark, sf_dir, "documents"))


@query()
def op10_toxicity(spark, sf_dir):
    """Contract of op10: fitted on labelled rows whose crc32 mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c
"""


@query(_OP7)
def op7_embedding_near_dedup(spark, sf_dir):
    """Contract of op7: cosine of 0.93 or more within a label."""
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


@query(licences.oracle())
def op1_license_scan(spark, sf_dir):
    """Known licence sentences and the licences their sequences match, for every document."""
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licence_sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))


#: Parameters of the mix: web sources weigh most, and English is to be half of each domain's budget against two others.
MIX = {"budget_share": 0.6, "max_epochs": 3, "seed": 17, "weights": {"domain": {"web": 3.0, "books": 2.0, "code": 1.0}, "lang": {"en": 3.0}, "source": {"src0": 2.0}}}


def mix_domain():
    """The domain of a source: three kinds by its number."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), F.pmod(number, F.lit(3)) + 1)


_DOMAIN = "['web', 'books', 'code'][(coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER), 0) % 3) + 1]"


@query(mixing.oracle(_DOMAIN, **MIX))
def op8_source_mixing(spark, sf_dir):
    """Documents and the epochs that the mix takes them in."""
    taken = mixing.mix(table(spark, sf_dir, "documents"), mix_domain(), **MIX)
    return taken.select("doc_id", F.col("_domain").alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"))


#: The tool that chats without tool messages are read as calls of.
REPLY = {"reply": {"prompt": {"type": "string", "required": True, "least": 1}, "turn": {"type": "integer", "required": True, "least": 0}, "words": {"type": "integer", "required": True, "most": 50}}}

_OP9 = r"""
WITH c AS (
  SELECT conv_id, concat_ws(':', conv_id, turn) AS call_id, turn AS pos, coalesce(text, '') AS text,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words, count(*) OVER (PARTITION BY conv_id, turn) - 1 AS more,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS i
  FROM conversations WHERE role = 'user'),
r AS (
  SELECT conv_id, concat_ws(':', conv_id, turn - 1) AS call_id, turn AS result_pos, text AS content,
    count(*) OVER (PARTITION BY conv_id, turn) - 1 AS more, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS i
  FROM conversations WHERE role = 'assistant'),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.pos, r.result_pos, c.text, c.words, r.content,
    coalesce(c.more, 0) + coalesce(r.more, 0) AS repeats,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status
  FROM (SELECT * FROM c WHERE i = 1) c FULL JOIN (SELECT * FROM r WHERE i = 1) r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, pos, result_pos, status, coalesce(pos, result_pos) AS at, 0 AS depth, repeats,
  CASE WHEN pos IS NULL THEN '' ELSE concat_ws(',', CASE WHEN text = '' THEN 'least of prompt' END, CASE WHEN words > 50 THEN 'most of words' END) END AS errors,
  '{"arguments":' || CASE WHEN pos IS NULL THEN 'null' ELSE '{"prompt":' || to_json(text) || ',"turn":' || pos || ',"words":' || words || '}' END
    || ',"content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"id":' || to_json(call_id)
    || ',"name":' || CASE WHEN pos IS NULL THEN 'null' ELSE '"reply"' END || ',"status":"' || status || '"}' AS message
FROM j WHERE conv_id IS NOT NULL
"""


@query(_OP9)
def op9_tool_call_linking(spark, sf_dir):
    """Every exchange of the conversations as a linked, ordered, checked and serialised tool call."""
    found = tool_calls.link(*tool_calls.from_exchanges(table(spark, sf_dir, "conversations")), REPLY)
    return found.select("conv_id", "call_id", "pos", "result_pos", "status", "at", "depth", "repeats", F.array_join("errors", ",").alias("errors"), "message")


@query(prefix_trie.oracle())
def op11_conversation_prefix_trie(spark, sf_dir):
    """Contract of op11: the trie of the rebuilt conversations."""
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


@query()
def op12_spot_signatures(spark, sf_dir):
    """Contract of op12: fingerprints of texts and their edits, and how alike they are."""
    found = spot_signatures.with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own, edited = (spot_signatures.fingerprint(F.col(c)) for c in ("signatures", "signatures_edited"))
    near = [spot_signatures.likeness(F.col("signatures"), F.col(f"signatures_{k}")).alias(f"near_{k}") for k in ("edited", "next")]
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), own.alias("fingerprint"), edited.alias("edited_fingerprint"), *near)


@query(fill_middle.oracle())
def op13_fill_in_middle(spark, sf_dir):
    """Contract of op13: seed 42, half of the documents, four fifths of them with the suffix first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fim, sha = F.col("_fim"), lambda c: F.sha2(c.cast("binary"), 256)
    return fill_middle.fill_in_middle(docs).select("doc_id", "_fim.n", "_fim.form", "_fim.prefix_chars", "_fim.middle_chars", sha(fim["output"]).alias("output_sha256"), sha(fill_middle.restored(fim["output"], fim["form"])).alias("restored_sha256"))

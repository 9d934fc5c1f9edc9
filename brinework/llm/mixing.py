"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A token budget goes down a domain-language-source tree by weight. A child that has too few tokens, counting its epochs,
gives what it lacks to its siblings; only what they all lack goes up to its parent's siblings. Each source then takes
whole epochs and a prefix of one more, in a seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.llm.common import cut, free_name

LEVELS = ("domain", "lang", "source")
#: Hex digits of the key by which a source's order is summed at a time; only the bucket in which the budget ends is
#: looked into further, so a source that holds a third of all rows needs no task of its own.
DIGITS = 2
#: Rows of a source, about, that may be summed one by one.
FEW_ROWS = 500
#: Leaves up to which their table is broadcast.
FEW_LEAVES = 50_000


def tokens_of(text: Column) -> Column:
    """Words of a text between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (parent columns, name, weight, capacity, amount of the parent) with ``share``: the amount by weight,
    at most the capacity, and what that leaves over by weight among the others."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.try_divide("capacity", "weight").asc_nulls_last(), name)
    sized = children.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("before", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    full = (F.col("weight") > 0) & (F.col("capacity").cast("double") * F.col("rest") <= F.col("weight") * (F.col("amount") - F.col("before")).cast("double"))
    sized = sized.withColumn("full", full)
    over = F.col("amount") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(by)
    weights = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(by)
    part = F.floor(F.coalesce(F.try_divide(F.col("weight") * over.cast("double"), weights), F.lit(0.0))).cast("long")
    return sized.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.greatest(part, F.lit(0)))).drop("rest", "before", "full")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    known = weights.get(level) or {}
    if not known:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in known.items() for x in (kv[0], float(kv[1]))))[F.col(level)], F.lit(1.0))


def budgets(leaves: DataFrame, budget: int, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, supply) with the tokens each is to give."""
    leaves = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    amount: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        parent, own = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*own).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        nodes = nodes.withColumn("amount", F.lit(budget).cast("long")) if amount is None else nodes.join(amount, parent)
        amount = cut(shared_out(nodes, parent, level).select(*own, F.col("share").alias("amount")))
    return leaves.drop("capacity").join(amount.withColumnRenamed("amount", "tokens_due"), list(LEVELS))


def _levels(most_rows: int) -> int:
    """How often a source's order is cut into ``16 ** DIGITS`` buckets until one of them has few rows."""
    levels = 1
    while most_rows > FEW_ROWS * 16 ** (DIGITS * levels):
        levels += 1
    return levels


def _ends(keyed: DataFrame, small, levels: int) -> DataFrame:
    """(leaf, last_key): the greatest key that fits in what is left for the last epoch of each leaf whose budget ends
    within it, or nothing where no row fits; ``keyed``: (leaf, extra, key, tokens). Leaves that are taken whole are not
    listed."""
    up_to = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left, prefix = keyed.withColumn("before", F.lit(0).cast("long")), 0
    for _ in range(levels):
        prefix += DIGITS
        left = left.withColumn("bucket", F.substring("key", 1, prefix))
        sums = left.groupBy(*LEVELS, "bucket", "extra", "before").agg(F.sum("tokens").alias("tokens"))
        ends = sums.withColumn("till", F.col("before") + F.sum("tokens").over(up_to(LEVELS, "bucket"))).where("till > extra")
        ends = cut(ends.groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", (F.col("till") - F.col("tokens")).alias("before")), "bucket").alias("end")).select(*LEVELS, F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("till_here")))
        left = left.join(small(ends), list(LEVELS)).where("bucket = end_bucket").select(*LEVELS, "extra", "key", "tokens", F.col("till_here").alias("before"))
    last = left.groupBy(*LEVELS, "before", "extra", "key").agg(F.sum("tokens").alias("tokens"))
    fit = last.withColumn("till", F.col("before") + F.sum("tokens").over(up_to(LEVELS, "key"))).where("till <= extra").groupBy(*LEVELS).agg(F.max("key").alias("last_key"))
    # with no row of the last bucket, what comes before that bucket still fits
    return ends.join(fit, list(LEVELS), "left").select(*LEVELS, F.coalesce("last_key", "end_bucket").alias("last_key"))


def mix(docs: DataFrame, domain: Column, budget_share: float = 0.5, weights: dict[str, dict[str, float]] | None = None, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain_as: str = "_domain", tokens_as: str = "_tokens", epoch_as: str = "_epoch") -> DataFrame:
    """The selected rows of ``docs``, once for each epoch they are in, with ``_domain``, ``_tokens`` and ``_epoch``.

    The budget is ``budget_share`` of all tokens. Weights not given are 1; a weight of 0 takes nothing while a sibling
    has any. A source's order in epoch e is that of md5(seed:e:id); it is cut before the row that would pass what the
    source is to give, so no source gives more than that. Rows with one id (null ids count as one) stand at one place
    and are taken together. Null domain, language or source count as the empty name, null texts as 0 tokens. Other
    columns stay; columns with the names of the three new ones are replaced, so name others in ``domain_as``,
    ``tokens_as`` and ``epoch_as`` to keep them. An empty input gives an empty result."""
    weights = weights or {}
    own = {k: free_name(docs, f"_mix_{k}") for k in (*LEVELS, "tokens", "epochs", "last_key", "upto", "epoch")}
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    named = docs.withColumns({own["domain"]: text_of(domain), own["tokens"]: tokens_of(F.col(text_col)), own["lang"]: text_of(F.col(lang_col)), own["source"]: text_of(F.col(source_col))})
    name = text_of(F.col(id_col))
    narrow = cut(named.select(name.alias("id"), *(F.col(own[k]).alias(k) for k in (*LEVELS, "tokens"))))
    leaves = cut(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"), F.count("*").alias("rows")))
    total, n_leaves, most_rows = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)), F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    small = (lambda df: F.broadcast(df)) if n_leaves <= FEW_LEAVES else (lambda df: df)

    due = budgets(leaves.drop("rows"), int(total * budget_share), weights, max_epochs)
    whole = F.coalesce(F.floor(F.try_divide("tokens_due", "supply")), F.lit(0)).cast("long")
    due = cut(due.withColumn("epochs", whole).withColumn("extra", F.col("tokens_due") - F.col("epochs") * F.col("supply")).select(*LEVELS, "epochs", "extra"))

    def key(epochs, row_id):
        return F.md5(F.concat_ws(":", F.lit(seed), epochs + 1, row_id))

    keyed = narrow.join(small(due), list(LEVELS)).withColumn("key", key(F.col("epochs"), F.col("id")))
    ends = _ends(keyed.select(*LEVELS, "extra", "key", "tokens"), small, _levels(most_rows))
    table = cut(due.join(ends, list(LEVELS), "left")).select(*(F.col(k).alias(own[k]) for k in (*LEVELS, "epochs", "last_key")))

    # a key is longer than the bucket that it is in, and so greater
    in_prefix = F.col(own["last_key"]).isNull() | (key(F.col(own["epochs"]), name) <= F.col(own["last_key"]))
    upto = F.col(own["epochs"]) + F.when(in_prefix, 1).otherwise(0)
    taken = named.join(small(table), [own[k] for k in LEVELS]).withColumn(own["upto"], upto).where(F.col(own["upto"]) > 0)
    taken = taken.withColumn(own["epoch"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(own["upto"]))))
    stay = [c for c in docs.columns if c not in (domain_as, tokens_as, epoch_as)]
    return taken.select(*stay, F.col(own["domain"]).alias(domain_as), F.col(own["tokens"]).alias(tokens_as), F.col(own["epoch"]).alias(epoch_as))


def oracle(domain: str, budget_share: float, weights: dict[str, dict[str, float]], max_epochs: int, seed: int) -> str:
    """DuckDB SQL of ``mix`` over ``documents``; ``domain``: its SQL."""

    def weight(level):
        return "CASE " + level + " " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in weights[level].items()) + " ELSE 1.0 END" if weights.get(level) else "1.0"

    steps = []
    for depth, level in enumerate(LEVELS):
        own, up = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {up}" if up else ""
        src = f"SELECT {own}, CAST(sum(cap) AS BIGINT) AS cap, CAST({weight(level)} AS DOUBLE) AS w FROM leaf GROUP BY {own}"
        amount = "(SELECT CAST(floor(sum(supply) * CAST(%s AS DOUBLE)) AS BIGINT) FROM leaf)" % budget_share if not up else "a.share"
        frm = f"({src}) n" + (f" JOIN r{depth - 1} a USING ({up})" if up else "")
        steps.append(f"""
p{depth} AS (SELECT {own}, cap, w, {amount} AS amount FROM {frm}),
q{depth} AS (SELECT *, sum(w) OVER ({by} ORDER BY CASE WHEN w > 0 THEN cap / w END NULLS LAST, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  coalesce(sum(cap) OVER ({by} ORDER BY CASE WHEN w > 0 THEN cap / w END NULLS LAST, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p{depth}),
f{depth} AS (SELECT *, w > 0 AND CAST(cap AS DOUBLE) * rest <= w * CAST(amount - before AS DOUBLE) AS is_full FROM q{depth}),
r{depth} AS (SELECT {own}, CAST(CASE WHEN is_full THEN cap ELSE greatest(0, floor(coalesce(w * CAST(amount - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS DOUBLE)
  / nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by}), 0), 0))) END AS BIGINT) AS share FROM f{depth})""")
    return rf"""
WITH d AS (
  SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply, CAST(sum(tokens) AS BIGINT) * {max_epochs} AS cap FROM d GROUP BY ALL),
{",".join(steps)},
due AS (
  SELECT domain, lang, source, coalesce(CAST(floor(share / nullif(supply, 0)) AS BIGINT), 0) AS epochs, supply, share FROM r2 JOIN leaf USING (domain, lang, source)),
o AS (
  SELECT d.*, epochs, share - epochs * supply AS extra,
    sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || (epochs + 1) || ':' || doc_id)) AS till FROM d JOIN due USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, unnest(range(1, epochs + CASE WHEN till <= extra THEN 1 ELSE 0 END + 1)) AS epoch FROM o
"""

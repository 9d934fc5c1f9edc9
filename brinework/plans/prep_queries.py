"""Cleaning, preparation, chart and catalog queries over the test tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brinework.functions import scalars
from brinework.operators import anomaly, charts, cleaning, profile, recipes, relational
from brinework.plans.profile_queries import LI, li, rounded
from brinework.plans.registry import query
from brinework.sources import catalog


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def keyed(spark, d):
    """``li`` with the key of each line, and what it was made from."""
    x = t(spark, d, "lineitem")
    keep = lambda c, k, m: F.when(F.col(k) % m != 0, F.col(c))
    return x.select("l_orderkey", "l_linenumber", keep("l_quantity", "l_orderkey", 7).alias("qty"), F.col("l_extendedprice").alias("price"), keep("l_returnflag", "l_orderkey", 5).alias("flag"))


KEYED = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty, l_extendedprice AS price, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag FROM lineitem)"
# a cell's key may repeat, so frames are compared through grouped digests
DUPED = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0)"


def duped(spark, d):
    o = t(spark, d, "orders")
    return o.union(o.where("o_orderkey % 10 = 0"))


def digest(df, by, **sums):
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.sum(c), 4).alias(k) for k, c in sums.items()))


@query("""
WITH c AS (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey / 1.0 AS b, (c_custkey % 7) / 2.0 AS c, (c_custkey % 5) / 2.0 AS d, (c_custkey % 3) / 2.0 AS e FROM customer),
n AS (
  SELECT x.c_custkey, count(*) >= 4 AS core FROM c x JOIN c y ON abs(x.a - y.a) <= 0.8
    AND (x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2 + (x.e - y.e) ** 2 <= 0.8 * 0.8 GROUP BY x.c_custkey),
r AS (
  SELECT DISTINCT x.c_custkey FROM c x JOIN c y ON abs(x.a - y.a) <= 0.8 JOIN n ON n.c_custkey = y.c_custkey AND n.core
    WHERE (x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2 + (x.e - y.e) ** 2 <= 0.8 * 0.8)
SELECT c.c_custkey, r.c_custkey IS NULL AS odd FROM c LEFT JOIN r ON r.c_custkey = c.c_custkey
""")
def dbscan_five_columns(spark, d):
    k = F.col("c_custkey")
    x = t(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("a"), (F.col("c_nationkey") / 1.0).alias("b"), (k % 7 / 2.0).alias("c"), (k % 5 / 2.0).alias("d"), (k % 3 / 2.0).alias("e"))
    return anomaly.dbscan_noise(x, list("abcde"), 0.8, 4, "odd").select("c_custkey", "odd")


@query("""
WITH a AS (SELECT CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey END AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS s, count(*) AS n FROM customer GROUP BY 1, 2),
b AS (SELECT CASE WHEN c_nationkey % 6 <> 0 THEN c_nationkey END AS k, CASE WHEN c_custkey % 2 <> 0 THEN c_mktsegment END AS s, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.s, b.s) AS s, a.n AS n_x, b.n AS n_y FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.s IS NOT DISTINCT FROM b.s
""")
def merge_null_keys(spark, d):
    """An outer merge by keys that hold nulls, which meet as other values do."""
    c = t(spark, d, "customer")
    side = lambda i, j: c.groupBy(F.when(F.col("c_nationkey") % i != 0, F.col("c_nationkey")).alias("k"), F.when(F.col("c_custkey") % j != 0, F.col("c_mktsegment")).alias("s")).agg(F.count("*").alias("n"))
    return relational.merge([side(4, 3), side(6, 2)], ["k", "s"], "outer")


@query(f"SELECT flag, count(*) AS n, round(sum(coalesce(qty, m)), 4) AS qty FROM (SELECT coalesce(flag, f) AS flag, qty, m FROM {KEYED}, (SELECT quantile_cont(qty, 0.5) AS m FROM {KEYED}), (SELECT arg_min(flag, (-n, flag)) AS f FROM (SELECT flag, count(*) AS n FROM {KEYED} WHERE flag IS NOT NULL GROUP BY 1))) GROUP BY 1")
def fill_median_mode(spark, d):
    return digest(cleaning.fill(keyed(spark, d)), ["flag"], qty="qty")


@query(f"SELECT count(*) AS n, round(sum(coalesce(qty, m)), 4) AS qty FROM {KEYED}, (SELECT avg(qty) AS m FROM {KEYED})")
def fill_mean(spark, d):
    return digest(cleaning.fill(keyed(spark, d), "mean", columns=["qty"]), [], qty="qty")


@query(f"SELECT count(*) AS n FROM (SELECT * FROM {KEYED} WHERE qty IS NOT NULL AND flag IS NOT NULL)")
def drop_missing(spark, d):
    return cleaning.drop_missing(keyed(spark, d)).agg(F.count("*").alias("n"))


_SERIES = "(SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events)"


def series(spark, d):
    return t(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))


@query(f"SELECT user_id, event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {_SERIES}")
def forward_fill(spark, d):
    return cleaning.carry(series(spark, d), "value", ["ts", "event_id"], ["user_id"]).select("user_id", "event_id", "value")


@query(f"""
SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value,
  first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following
FROM {_SERIES}
""")
def fill_one_order(spark, d):
    """Forward and backward fill in one order of all events, by ranges of about a thousand."""
    both = cleaning.carry_both(series(spark, d), "value", "following", ["ts", "event_id"], range_rows=1000)
    return both.select("event_id", "value", "following")


@query(f"""
SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN b.x = a.x THEN NULL ELSE a.y + (b.y - a.y) * (event_id - a.x) / (b.x - a.x) END, 6) AS value FROM (
  SELECT event_id, value, last_value(p IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
    first_value(p IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM (SELECT event_id, value, CASE WHEN value IS NOT NULL THEN struct_pack(x := CAST(event_id AS DOUBLE), y := value) END AS p FROM {_SERIES}))
""")
def interpolate_one_order(spark, d):
    return cleaning.interpolate(series(spark, d), "value", "event_id", range_rows=1000).select("event_id", F.round("value", 6).alias("value"))


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_name DESC) AS down, dense_rank() OVER (ORDER BY c_name) - 1 AS code FROM customer")
def label_encode_names(spark, d):
    """Codes of a text column with a value for each row, placed by ranges."""
    names = t(spark, d, "customer").select("c_custkey", "c_name")
    coded = cleaning.label_encode(names.withColumnRenamed("c_name", "code"), "code")
    return coded.join(names.agg(F.count_distinct("c_name").alias("n"))).select("c_custkey", (F.col("n") - F.col("code")).alias("down"), "code")


@query(f"SELECT user_id, event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {_SERIES}")
def backward_fill(spark, d):
    return cleaning.carry(series(spark, d), "value", ["ts", "event_id"], ["user_id"], forward=False).select("user_id", "event_id", "value")


@query(f"""
WITH s AS (SELECT user_id, event_id, value, last_value(CASE WHEN value IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS x0, last_value(value IGNORE NULLS) OVER b AS y0,
  first_value(CASE WHEN value IS NOT NULL THEN event_id END IGNORE NULLS) OVER a AS x1, first_value(value IGNORE NULLS) OVER a AS y1 FROM {_SERIES}
  WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(coalesce(value, y0 + (y1 - y0) * (event_id - x0) / (x1 - x0)), 7) AS value FROM s""")
def interpolate(spark, d):
    return cleaning.interpolate(series(spark, d), "value", "event_id", ["user_id"]).select("user_id", "event_id", F.round("value", 7).alias("value"))


@query("SELECT DISTINCT * FROM orders")
def dedupe_rows(spark, d):
    return cleaning.drop_duplicates(duped(spark, d))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) WHERE i = 1")
def dedupe_first(spark, d):
    return cleaning.drop_duplicates(duped(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) WHERE i = 1")
def dedupe_last(spark, d):
    return cleaning.drop_duplicates(duped(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"], "last").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0")
def dedupe_none(spark, d):
    return cleaning.drop_duplicates(duped(spark, d), ["o_orderkey"], keep="none").select("o_orderkey")


_FENCE = "(SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)"
_ODD = "(o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a))"


@query(f"SELECT o_orderkey, round(least(greatest(o_totalprice, lo), hi), 4) AS o_totalprice FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders, {_FENCE} WHERE NOT {_ODD})")
def cap_outliers(spark, d):
    return rounded(cleaning.treat_outliers(t(spark, d, "orders"), ["o_totalprice"], "cap", threshold=0.5).select("o_orderkey", "o_totalprice"), 4)


@query(f"SELECT o_orderkey FROM orders, {_FENCE} WHERE NOT {_ODD}")
def remove_outliers(spark, d):
    return cleaning.treat_outliers(t(spark, d, "orders"), ["o_totalprice"], "remove", threshold=0.5).select("o_orderkey")


@query(f"SELECT o_orderkey, round(CASE WHEN {_ODD} THEN m ELSE o_totalprice END, 4) AS o_totalprice FROM orders, {_FENCE}, (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders, {_FENCE} WHERE NOT {_ODD})")
def impute_outliers(spark, d):
    return rounded(cleaning.treat_outliers(t(spark, d, "orders"), ["o_totalprice"], "impute", threshold=0.5).select("o_orderkey", "o_totalprice"), 4)


@query("SELECT o_orderkey, abs(o_totalprice - m) > 1.5 * s AS odd FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def zscore_flags(spark, d):
    return cleaning.outlier_flags(t(spark, d, "orders"), ["o_totalprice"], "zscore", 1.5).select("o_orderkey", F.col("o_totalprice_outlier").alias("odd"))


@query("SELECT o_orderkey, least(greatest(o_totalprice, lo), hi) AS o_totalprice FROM orders, (SELECT min(v) FILTER (i > CAST(floor(n * 0.05) AS BIGINT)) AS lo, min(v) FILTER (i >= n - CAST(floor(n * 0.05) AS BIGINT)) AS hi FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders))")
def winsorize(spark, d):
    return cleaning.winsorize(t(spark, d, "orders"), "o_totalprice").select("o_orderkey", "o_totalprice")


_SCALES = {
    "standard": "(o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()",
    "minmax": "(o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ())",
    "robust": "(o_totalprice - quantile_cont(o_totalprice, 0.5) OVER ()) / (quantile_cont(o_totalprice, 0.75) OVER () - quantile_cont(o_totalprice, 0.25) OVER ())",
    "maxabs": "o_totalprice / max(abs(o_totalprice)) OVER ()",
    "quantile": "(rank() OVER (ORDER BY o_totalprice) - 1) / (count(*) OVER () - 1)",
    "log": "ln(1 + o_totalprice)",
    "sqrt": "sqrt(o_totalprice)",
}
for _how, _sql in _SCALES.items():
    query(f"SELECT o_orderkey, round({_sql}, 6) AS o_totalprice FROM orders", name=f"scale_{_how}")(lambda spark, d, how=_how: rounded(cleaning.scale(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], how)))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders")
def label_encode(spark, d):
    return cleaning.label_encode(t(spark, d, "orders"), "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("""SELECT o_orderkey, o_orderstatus = 'O' AS "o_orderstatus_O", o_orderstatus = 'P' AS "o_orderstatus_P" FROM orders""")
def onehot_encode(spark, d):
    return cleaning.one_hot(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS o_orderstatus FROM orders")
def ordinal_encode(spark, d):
    return cleaning.ordinal_encode(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["O", "F"])


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS o_orderpriority_target FROM orders")
def target_encode(spark, d):
    return rounded(cleaning.target_encode(t(spark, d, "orders"), "o_orderpriority", "o_totalprice").select("o_orderkey", "o_orderpriority_target"), 4)


@query("SELECT o_orderkey, c & 1 AS o_orderpriority_bit_0, (c >> 1) & 1 AS o_orderpriority_bit_1, (c >> 2) & 1 AS o_orderpriority_bit_2 FROM (SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS c FROM orders)")
def binary_encode(spark, d):
    return cleaning.binary_encode(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


_RULES = {"o_orderkey": {"type": "bigint", "min": 10}, "o_totalprice": {"max": 400000.0}, "o_orderstatus": {"allowed": ["O", "F"]}, "o_orderpriority": {"pattern": "[1-3]-"}, "o_gone": {"required": True}}


@query("SELECT * FROM (SELECT 'o_orderkey' AS \"column\", 'min' AS rule, count(*) FILTER (o_orderkey < 10) AS violations FROM orders UNION ALL SELECT 'o_totalprice', 'max', count(*) FILTER (o_totalprice > 400000) FROM orders UNION ALL SELECT 'o_orderstatus', 'allowed', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM orders UNION ALL SELECT 'o_orderpriority', 'pattern', count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]-')) FROM orders UNION ALL SELECT 'o_gone', 'required', 1) WHERE violations > 0")
def schema_violations(spark, d):
    return cleaning.schema_violations(t(spark, d, "orders"), _RULES)


_BROKEN = {("o_orderkey", "min"): "o_orderkey < 10", ("o_totalprice", "max"): "o_totalprice > 400000", ("o_orderstatus", "allowed"): "o_orderstatus NOT IN ('O', 'F')", ("o_orderpriority", "pattern"): "NOT regexp_matches(o_orderpriority, '^[1-3]-')"}


@query("SELECT *, rule IN ('min', 'max') AS fixable, CASE WHEN rule IN ('required', 'allowed') THEN 'error' ELSE 'warning' END AS severity, false AS valid FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{r}' AS rule, count(*) AS violations, array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR)))[1:5], '|') AS samples FROM orders WHERE {e}" for (c, r), e in _BROKEN.items()) + " UNION ALL SELECT 'o_gone', 'required', 1, NULL) WHERE violations > 0")
def schema_report(spark, d):
    return cleaning.schema_report(t(spark, d, "orders"), _RULES).withColumn("samples", F.array_join("samples", "|"))


@query("""SELECT "column", type, nulls, round(mean, 6) AS mean, row_number() OVER (ORDER BY mean DESC NULLS LAST, "column") AS place FROM (
SELECT 'o_orderkey' AS "column", 'bigint' AS type, count(*) - count(o_orderkey) AS nulls, avg(o_orderkey) AS mean FROM orders UNION ALL SELECT 'o_orderstatus', 'string', count(*) - count(o_orderstatus), NULL FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', count(*) - count(o_orderpriority), NULL FROM orders)""")
def statistics_table(spark, d):
    """Columns with "order" in their name, by mean; those without one rank lowest."""
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    got = catalog.statistics_table(profile.column_profile(o).select("column", "type", "nulls", "mean"), "ORDER", order="mean", descending=True)
    return rounded(got.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("mean"), "column")).cast("long")))


def _priorities(spark, d):
    """Orders of each priority as datasets of a catalog."""
    each = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name"))
    return each.agg(F.max("o_orderkey").alias("created_at"), F.when(F.col("name") != "5-LOW", F.count("*")).alias("file_size"), F.sort_array(F.collect_set("o_orderstatus")).alias("tags"))


_SETS = "(SELECT o_orderpriority AS name, max(o_orderkey) AS created_at, CASE WHEN o_orderpriority <> '5-LOW' THEN count(*) END AS file_size FROM orders GROUP BY 1)"


@query(f"SELECT name, created_at FROM {_SETS} ORDER BY created_at DESC, name LIMIT 3")
def recent_datasets(spark, d):
    return catalog.recent(_priorities(spark, d), 3).select("name", "created_at")


@query(f"SELECT name, file_size FROM {_SETS}")
def datasets_by_size(spark, d):
    return catalog.by_size(_priorities(spark, d)).select("name", "file_size")


@query("SELECT DISTINCT o_orderpriority AS name FROM orders WHERE o_orderstatus = 'P'")
def tagged_datasets(spark, d):
    return catalog.tagged(_priorities(spark, d), "P").select("name")


@query(f"SELECT name, file_size FROM {_SETS} WHERE file_size >= 100 AND name <> '2-HIGH'")
def metadata_sql(spark, d):
    return catalog.ask(spark, "SELECT name, file_size FROM {sets} WHERE file_size >= :least AND name <> :other", {"least": 100, "other": "2-HIGH"}, sets=_priorities(spark, d))


@query("SELECT o_orderkey, least(greatest(o_totalprice, 1000.0), 400000.0) AS o_totalprice FROM orders")
def schema_fix(spark, d):
    return cleaning.fix_schema(t(spark, d, "orders"), {"o_totalprice": {"type": "double", "min": 1000.0, "max": 400000.0}}).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, TRY_CAST(replace(price, '$', '') AS DOUBLE) AS price, CASE yn WHEN 'yes' THEN TRUE ELSE FALSE END AS yn, day AS day FROM (SELECT event_id, '$' || CAST(event_id AS VARCHAR) AS price, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS yn, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events)")
def repair_types(spark, d):
    e = t(spark, d, "events").select("event_id", F.concat(F.lit("$"), "event_id").alias("price"), F.when(F.col("event_id") % 2 == 0, "yes").otherwise("no").alias("yn"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return cleaning.repair_types(e).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g'), '\s+', ' ', 'g')) AS text FROM conversations")
def clean_text(spark, d):
    return cleaning.clean_text(t(spark, d, "conversations").select("conv_id", "turn", "text"), "text")


_NUM = ["qty", "price", "disc", "tax"]
_SUMS = ", ".join(f"round(sum({c}), 3) AS {c}" for c in _NUM)


def sums_by_text(df):
    return df.groupBy("flag", "status").agg(F.count("*").alias("n"), *(F.round(F.sum(F.col(c).cast("double")), 3).alias(c) for c in _NUM))


@query(f"SELECT flag, status, count(*) AS n, {_SUMS} FROM (SELECT DISTINCT * FROM {LI}) WHERE qty IS NOT NULL AND tax IS NOT NULL AND flag IS NOT NULL GROUP BY ALL")
def clean_minimal(spark, d):
    return sums_by_text(recipes.clean(li(spark, d), "minimal"))


_FILLED = f"""
d AS (SELECT DISTINCT * FROM {LI}),
m AS (SELECT quantile_cont(qty, 0.5) AS mq, quantile_cont(tax, 0.5) AS mt FROM d), k AS (SELECT arg_min(flag, (-n, flag)) AS mf FROM (SELECT flag, count(*) AS n FROM d WHERE flag IS NOT NULL GROUP BY 1)),
f AS (SELECT coalesce(qty, mq) AS qty, price, disc, coalesce(tax, mt) AS tax, coalesce(flag, mf) AS flag, status FROM d, m, k),
v AS (SELECT coalesce(qty, mq) AS qty, price, disc, coalesce(tax, mt) AS tax, flag, status FROM d, m)"""
_FENCED = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_b" for c in _NUM)
_FAIR = {c: f"({c} BETWEEN {c}_a - 1.5 * ({c}_b - {c}_a) AND {c}_b + 1.5 * ({c}_b - {c}_a))" for c in _NUM}
_CAPS = ", ".join(f"min({c}) FILTER ({_FAIR[c]}) AS {c}_lo, max({c}) FILTER ({_FAIR[c]}) AS {c}_hi" for c in _NUM)


@query(f"""WITH {_FILLED}, q AS (SELECT {_FENCED} FROM v), e AS (SELECT {_CAPS} FROM v, q)
SELECT flag, status, count(*) AS n, {", ".join(f"round(sum(least(greatest({c}, {c}_lo), {c}_hi)), 3) AS {c}" for c in _NUM)} FROM v, e GROUP BY ALL""")
def clean_standard(spark, d):
    return sums_by_text(recipes.clean(li(spark, d), "standard"))


@query(f"WITH {_FILLED} SELECT flag, status, count(*) AS n, {_SUMS} FROM f GROUP BY ALL")
def clean_live(spark, d):
    return sums_by_text(recipes.live_clean(li(spark, d)))


@query(f"""WITH {_FILLED}, s AS (SELECT {", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _NUM)} FROM v)
SELECT "flag_N", "flag_R", "status_O", count(*) AS n, {", ".join(f"round(sum(({c} - {c}_m) / {c}_s), 3) + 0.0 AS {c}" for c in _NUM)} FROM (SELECT v.* EXCLUDE (flag, status), s.*, coalesce(flag = 'N', false) AS "flag_N", coalesce(flag = 'R', false) AS "flag_R", status = 'O' AS "status_O" FROM v, s) GROUP BY ALL""")
def clean_scaled_encoded(spark, d):
    """The steps of the model preset with strategies that SQL can say."""
    out = (recipes.distinct() + recipes.filled() + recipes.scaled("standard") + recipes.encoded("onehot"))(li(spark, d))
    return out.groupBy("flag_N", "flag_R", "status_O").agg(F.count("*").alias("n"), *((F.round(F.sum(c), 3) + 0.0).alias(c) for c in _NUM))


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce(qty, m), 4) AS qty, price, flag FROM {KEYED}, (SELECT avg(qty) AS m FROM {KEYED}) WHERE flag IS NOT NULL")
def fill_by_strategy(spark, d):
    return rounded(cleaning.fill_by_strategy(keyed(spark, d), "median", {"qty": "mean", "flag": "drop"}), 4)


@query(f"SELECT l_orderkey, l_linenumber, coalesce(qty, 7) AS qty, price, coalesce(flag, 'none') AS flag FROM {KEYED}")
def fill_values(spark, d):
    return cleaning.fill_values(keyed(spark, d), {"qty": 7.0, "flag": "none"})


@query(f"SELECT l_orderkey, l_linenumber, flag FROM {KEYED} WHERE flag IS NOT NULL")
def drop_missing_in_one(spark, d):
    return cleaning.drop_missing(keyed(spark, d), ["flag"]).select("l_orderkey", "l_linenumber", "flag")


_POINTS = "(SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal / 500 AS y FROM customer)"


@query(f"""WITH p AS (SELECT * FROM {_POINTS}), n AS (SELECT a.c_custkey AS k, b.c_custkey AS o FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.25),
c AS (SELECT k FROM n GROUP BY k HAVING count(*) >= 5) SELECT c_custkey, NOT EXISTS (SELECT 1 FROM n JOIN c ON c.k = n.o WHERE n.k = p.c_custkey) AS odd FROM p""")
def dbscan_flags(spark, d):
    x = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 500).alias("y"))
    return cleaning.outlier_flags(x, ["x", "y"], "dbscan").select("c_custkey", F.col("x_outlier").alias("odd"))


@query()
def forest_flags(spark, d):
    return cleaning.outlier_flags(li(spark, d), ["price", "disc"], "isolation_forest").groupBy("price_outlier").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN (SELECT bool_or(o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a)) FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)) THEN least(greatest(o_totalprice, lo), hi) ELSE o_totalprice END AS o_totalprice FROM orders, (SELECT min(v) FILTER (i > CAST(floor(n * 0.05) AS BIGINT)) AS lo, min(v) FILTER (i >= n - CAST(floor(n * 0.05) AS BIGINT)) AS hi FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders))")
def winsorize_flagged(spark, d):
    return cleaning.treat_outliers(t(spark, d, "orders"), ["o_totalprice"], "winsorize", threshold=0.5).select("o_orderkey", "o_totalprice")


@query("SELECT c AS \"column\", k AS \"distinct\", round(k / n, 8) AS ratio FROM (SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus) AS k, count(*) AS n FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders) WHERE k / n < 0.5")
def text_categories(spark, d):
    return rounded(cleaning.categories(t(spark, d, "orders")), 8)


@query("SELECT * FROM (VALUES ('n_nationkey', 'tinyint'), ('n_name', 'string'), ('n_regionkey', 'tinyint'), ('half', 'float'), ('third', 'double')) v(\"column\", type)")
def downcast_types(spark, d):
    n = cleaning.downcast(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey", (F.col("n_nationkey") / 2).alias("half"), (F.col("n_nationkey") / 3).alias("third")))
    return spark.createDataFrame(n.dtypes, "column string, type string")


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS a, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS b, make_timestamp(event_id * 1000000) AS c FROM events")
def parse_dates(spark, d):
    e = t(spark, d, "events").select("event_id", F.date_format("ts", "MM/dd/yyyy").alias("a"), F.date_format("ts", "dd.MM.yyyy").alias("b"), F.col("event_id").alias("c"))
    out = cleaning.parse_dates(cleaning.parse_dates(cleaning.parse_dates(e, "a"), "b", "dd.MM.yyyy"), "c", unit="s")
    return out.withColumns({x: F.col(x).cast("timestamp_ntz") for x in "abc"})


@query("SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS c_name, upper(c_mktsegment) AS c_mktsegment FROM customer")
def standardize(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return cleaning.standardize(cleaning.standardize(c, "c_name", "digits"), "c_mktsegment", "upper")


@query("""
SELECT o_orderkey, TRY_CAST(o_orderpriority AS BIGINT) AS priority, TRY_CAST(o_orderpriority[1:1] AS BIGINT) AS digit, CAST(o_totalprice AS VARCHAR) AS price, CAST(trunc(o_totalprice) AS BIGINT) AS whole,
  o_custkey % 2 = 1 AS odd, o_orderpriority AS kept FROM orders""")
def convert_types(spark, d):
    """Texts that are no numbers, and some that are; numbers as texts, whole numbers and truth values; a column that is
    kept because not all of it can be cast."""
    out = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.substring("o_orderpriority", 1, 1).alias("digit"), F.col("o_totalprice").alias("price"), F.col("o_totalprice").alias("whole"), (F.col("o_custkey") % 2).alias("odd"), F.col("o_orderpriority").alias("kept"))
    for c, kind in {"priority": "int", "digit": "int", "price": "str", "whole": "int", "odd": "bool"}.items():
        out = cleaning.convert(out, c, kind)
    return cleaning.convert(out, "kept", "int", "ignore")


@query("SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def kept_parameters(spark, d):
    """Scaling and codes fitted on one frame and used on another."""
    o = t(spark, d, "orders")
    scaled = cleaning.scale_by(o, cleaning.scale_parameters(o, ["o_totalprice"]))
    return rounded(cleaning.encode_by(scaled, "o_orderpriority", cleaning.code_parameters(o, "o_orderpriority")).select("o_orderkey", "o_totalprice", "o_orderpriority"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 200000")
def range_plugin(spark, d):
    recipes.PLUGINS["mid_range"] = recipes.value_range("o_totalprice", 50000, 200000)
    out = recipes.clean(t(spark, d, "orders"), plugins=["mid_range"], missing_strategy="none", remove_duplicates=False, outlier_detection=False, optimize_dtypes=False)
    return out.select("o_orderkey", "o_totalprice")


@query("""
SELECT c_custkey, lower(regexp_replace(regexp_replace(c_name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[\\s-]', '_', 'g')) AS snake, lower(regexp_replace(c_name, '[\\s_]', '-', 'g')) AS kebab, regexp_replace(lower(trim(c_name)), '[^a-z0-9_\\s-]', '', 'g') AS slug,
  upper(c_name[1]) || lower(c_name[2:]) AS sentence, CASE WHEN length(c_name) <= 12 THEN c_name ELSE c_name[1:9] || '...' END AS short, rpad(c_mktsegment, 12, '*') AS padded, least(greatest(c_acctbal, 0), 5000) AS clamped,
  round((c_acctbal - 0) * 100 / 10000.0, 6) AS mapped, round((c_acctbal + 1000) / 11000.0, 8) AS normal, c_custkey % 2 = 0 AS even, round(c_acctbal * 100 / 5000.0, 6) AS share, round((c_acctbal - 5000) * 100 / 5000.0, 6) AS change,
  regexp_matches(c_name || '@x.org', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') AS email, regexp_matches(CAST(c_custkey AS VARCHAR), '^[+-]?[0-9]+$') AS whole, length(c_name) BETWEEN 3 AND 30 AS fits, 'C***@x.org' AS masked,
  '(' || lpad(CAST(c_custkey AS VARCHAR), 10, '0')[1:3] || ') ' || lpad(CAST(c_custkey AS VARCHAR), 10, '0')[4:6] || '-' || lpad(CAST(c_custkey AS VARCHAR), 10, '0')[7:] AS phone, floor(c_acctbal * 10 + 0.5) / 10 AS rounded
FROM customer""")
def scalar_functions(spark, d):
    c, n, s = F.col("c_custkey"), "c_name", scalars
    ten = F.lpad(c.cast("string"), 10, "0")
    return t(spark, d, "customer").select(
        "c_custkey", s.snake(n).alias("snake"), s.kebab(n).alias("kebab"), s.slug(n).alias("slug"), s.sentence(n).alias("sentence"), s.truncated(n, 12).alias("short"), s.padded("c_mktsegment", 12, "*").alias("padded"),
        s.clamped("c_acctbal", 0.0, 5000.0).alias("clamped"), F.round(s.mapped("c_acctbal", 0, 10000, 0, 100), 6).alias("mapped"), F.round(s.normalized("c_acctbal", -1000, 10000), 8).alias("normal"), s.even(c).alias("even"),
        F.round(s.percent_of("c_acctbal", 5000), 6).alias("share"), F.round(s.percent_change(F.lit(5000.0), F.col("c_acctbal")), 6).alias("change"), s.is_email(F.concat(n, F.lit("@x.org"))).alias("email"), s.is_integer(c).alias("whole"),
        s.has_length(n, 3, 30).alias("fits"), s.masked_email(F.concat(n, F.lit("@x.org"))).alias("masked"), s.phone_text(ten).alias("phone"), s.rounded_half_up("c_acctbal", 1).alias("rounded"),
    )


@query("""
WITH c AS (SELECT o_custkey, i // 3 AS chunk, sum(cents) AS s FROM (SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(round(o_totalprice * 100) AS BIGINT)) - 1 AS i FROM orders) GROUP BY ALL),
p AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT o.o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS kinds, round(sum(o_totalprice), 2) AS paid, any_value(chunks) AS chunks, any_value(firsts) AS firsts, round(avg(o_totalprice), 7) AS mean
FROM orders o JOIN (SELECT o_custkey, string_agg(CAST(s AS VARCHAR), ',' ORDER BY chunk) AS chunks FROM c GROUP BY 1) x ON x.o_custkey = o.o_custkey
JOIN (SELECT o_custkey, string_agg(o_orderpriority || '=' || k, ',' ORDER BY o_orderpriority) AS firsts FROM p GROUP BY 1) y ON y.o_custkey = o.o_custkey GROUP BY 1""")
def array_functions(spark, d):
    each = t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("s"), F.collect_list("o_totalprice").alias("p"), F.collect_list(F.struct("o_orderpriority", "o_orderkey")).alias("r"))
    cents = F.array_sort(F.transform("p", lambda v: F.round(v * 100).cast("long")))
    sums = F.transform(scalars.chunked(cents, 3), lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, v: a + v).cast("string"))
    by_key = F.array_sort("r", lambda a, b: (a["o_orderkey"] - b["o_orderkey"]).cast("int"))
    firsts = F.array_sort(F.transform(scalars.unique_by(by_key, "o_orderpriority"), lambda r: F.concat_ws("=", r["o_orderpriority"], r["o_orderkey"].cast("string"))))
    return each.select(
        "o_custkey", F.array_join(F.array_sort(F.array_distinct("s")), ",").alias("kinds"), F.round(scalars.array_total("p"), 2).alias("paid"),
        F.array_join(sums, ",").alias("chunks"), F.array_join(firsts, ",").alias("firsts"), F.round(scalars.array_mean("p"), 7).alias("mean"),
    )


@query("SELECT c_custkey, {'a': c_custkey, 'b': c_nationkey}.b AS b, CAST(json_extract_string('{\"x\":{\"y\":' || c_nationkey || '}}', '$.x.y') AS VARCHAR) AS y, 2 AS keys, c_nationkey AS newest FROM customer")
def map_functions(spark, d):
    m = F.create_map(F.lit("a"), F.col("c_custkey").cast("long"), F.lit("b"), F.col("c_nationkey").cast("long"))
    more = F.create_map(F.lit("a"), F.col("c_nationkey").cast("long"))
    doc = F.format_string('{"x":{"y":%d}}', F.col("c_nationkey"))
    return t(spark, d, "customer").select("c_custkey", scalars.picked(m, ["b"])["b"].alias("b"), scalars.nested(doc, "x.y").alias("y"), F.size(scalars.merged_maps(m, more)).alias("keys"), scalars.merged_maps(m, more)["a"].alias("newest"))


# rows and columns


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'P') AND starts_with(o_orderpriority, '1')")
def row_filter(spark, d):
    return relational.filter_rows(t(spark, d, "orders"), [("o_totalprice", ">", 100000), ("o_orderstatus", "in", ["F", "P"]), ("o_orderpriority", "startswith", "1")]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 100000 OR o_orderstatus = 'F')")
def row_filter_out(spark, d):
    return relational.filter_rows(t(spark, d, "orders"), [("o_totalprice", ">", 100000), ("o_orderstatus", "=", "F")], "or", keep=False).select("o_orderkey")


for _how in ("inner", "left", "right", "outer"):
    query(
        f"SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT o_custkey AS k, count(*) AS x FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1) a {'FULL' if _how == 'outer' else _how} JOIN (SELECT c_custkey AS k, c_acctbal AS y FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k", name=f"merge_{_how}"
    )(
        lambda spark, d, how=_how: relational.merge([t(spark, d, "orders").where("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("x")), t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("y"))], ["k"], how)
    )


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS a, CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 2) END AS b, c_name || '/' || c_mktsegment AS both FROM customer")
def split_combine(spark, d):
    c = relational.split_column(t(spark, d, "customer"), "c_name", "#", ["a", "b"])
    return relational.combine_columns(c, ["c_name", "c_mktsegment"], "both", "/").select("c_custkey", "a", "b", "both")


@query("SELECT o_orderkey, o_totalprice * 0.1 AS tenth, pow(o_custkey, 2) AS o_custkey_pow_2, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, day(o_orderdate) AS o_orderdate_day, isodow(o_orderdate) - 1 AS o_orderdate_weekday, hour(o_orderdate) AS o_orderdate_hour FROM orders")
def derive_features(spark, d):
    o = relational.derive(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), {"tenth": "o_totalprice * 0.1D"})
    out = relational.date_parts(relational.polynomial(o, ["o_custkey"]), "o_orderdate")
    return out.drop("o_totalprice", "o_orderdate", "o_custkey")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%an%' OR p_type ILIKE '%an%'")
def search_parts(spark, d):
    return relational.search(t(spark, d, "part"), "AN", ["p_name", "p_type"]).select("p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_of_orders(spark, d):
    return relational.page(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 3, 20, [F.desc("o_totalprice"), "o_orderkey"])


@query()
def sample_orders(spark, d):
    return relational.sample(t(spark, d, "orders"), 500, ["o_orderkey"])


# charts

_BINS = "WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders), b AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1) SELECT bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high, n FROM b, e"


@query(_BINS)
def histogram(spark, d):
    return rounded(charts.histogram(t(spark, d, "orders"), "o_totalprice"), 4)


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY 1")
def regression_line(spark, d):
    out = charts.regression_line(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return out.withColumns({"slope": F.round("slope", 5), "intercept": F.round("intercept", 4), "r": F.round("r", 6)})


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def pie_top15(spark, d):
    return charts.pie(t(spark, d, "part"), "p_brand")


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def bar_top20(spark, d):
    return rounded(charts.bar(t(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 2)


@query("""SELECT 'o_totalprice' AS "column", min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std FROM orders""")
def box_stats(spark, d):
    return charts.box(t(spark, d, "orders"), ["o_totalprice"]).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3, count(*) AS n FROM orders GROUP BY 1")
def violin(spark, d):
    return charts.violin(t(spark, d, "orders"), "o_totalprice", "o_orderstatus")


@query("SELECT o_orderdate, o_orderstatus, o_totalprice FROM orders")
def line_chart(spark, d):
    return charts.line(t(spark, d, "orders"), "o_orderdate", "o_totalprice", "o_orderstatus")


@query("SELECT ts, value FROM events")
def time_series(spark, d):
    return charts.time_series(t(spark, d, "events"), "ts", "value")


@query("SELECT o_orderstatus, count(o_totalprice) AS n, quantile_cont(o_totalprice, 0.5) AS mid, round(stddev_samp(o_totalprice), 4) AS sd, max(o_totalprice) AS top FROM orders GROUP BY 1")
def chart_aggregates(spark, d):
    out = charts.aggregated(t(spark, d, "orders"), ["o_orderstatus"], {"n": ("count", "o_totalprice"), "mid": ("median", "o_totalprice"), "sd": ("stdDev", "o_totalprice"), "top": ("max", "o_totalprice")})
    return out.withColumn("sd", F.round("sd", 4))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close FROM orders GROUP BY 1")
def ohlc(spark, d):
    return charts.ohlc(t(spark, d, "orders"), "o_orderdate", "o_totalprice", tie="o_orderkey")


@query("WITH e AS (SELECT min(o_orderkey) AS lo, (max(o_orderkey) - min(o_orderkey)) / 50 AS w FROM orders) SELECT CAST(least(floor((o_orderkey - lo) / w), 49) AS INTEGER) AS bucket, round(avg(o_orderkey), 4) AS x, max(o_totalprice) AS y FROM orders, e GROUP BY 1")
def downsample(spark, d):
    return charts.downsample(t(spark, d, "orders"), "o_orderkey", "o_totalprice", 50, "max").withColumn("x", F.round("x", 4))


@query("""
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, stddev_samp(o_totalprice) * pow(count(*), -0.2) AS h FROM orders),
b AS (SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 512), 511) AS INTEGER) AS b, count(*) AS c FROM orders, e GROUP BY 1),
p AS (SELECT i, lo + (hi - lo) * i / 19.0 AS x FROM e, range(20) r(i))
SELECT round(x, 2) AS x, round(1e6 * sum(c * exp(-0.5 * pow((x - (lo + (b + 0.5) * (hi - lo) / 512)) / h, 2)) / (n * h * sqrt(2 * pi()))), 6) AS density FROM p, b, e GROUP BY i, x""")
def density(spark, d):
    return charts.density(t(spark, d, "orders"), "o_totalprice", points=20).select(F.round("x", 2).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density"))


@query()
def largest_triangles(spark, d):
    return charts.largest_triangles(t(spark, d, "orders"), "o_orderkey", "o_totalprice", 100)


@query("""
WITH r AS (SELECT abs(corr(o_orderkey, o_custkey)) AS a, abs(corr(o_orderkey, o_totalprice)) AS b, abs(corr(o_custkey, o_totalprice)) AS c FROM orders),
s AS (SELECT 'distribution' AS chart, unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) AS columns, 1 AS k UNION ALL SELECT 'heatmap', 'o_orderkey,o_custkey,o_totalprice', 2
  UNION ALL SELECT 'categorical', 'o_orderstatus', 3 FROM (SELECT count(DISTINCT o_orderstatus) AS n FROM orders) WHERE n <= 20 UNION ALL SELECT 'categorical', 'o_orderpriority', 4 FROM (SELECT count(DISTINCT o_orderpriority) AS n FROM orders) WHERE n <= 20
  UNION ALL SELECT 'scatter', 'o_orderkey,o_custkey', 5 FROM r WHERE a > 0.5 UNION ALL SELECT 'scatter', 'o_orderkey,o_totalprice', 6 FROM r WHERE b > 0.5 UNION ALL SELECT 'scatter', 'o_custkey,o_totalprice', 7 FROM r WHERE c > 0.5
  UNION ALL SELECT 'box', 'o_orderkey,o_custkey,o_totalprice', 8)
SELECT chart, columns FROM s""")
def chart_suite(spark, d):
    return charts.suite(t(spark, d, "orders")).drop("rank")


@query("SELECT s AS stage, r AS rank, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'O'), 6) AS share FROM orders JOIN (VALUES ('O', 1), ('F', 2), ('P', 3)) v(s, r) ON s = o_orderstatus GROUP BY ALL")
def funnel(spark, d):
    return rounded(charts.funnel(t(spark, d, "orders"), "o_orderstatus", ["O", "F", "P"]))


@query("SELECT step, round(change, 2) AS change, round(total - change, 2) AS start, round(total, 2) AS \"end\" FROM (SELECT *, sum(change) OVER (ORDER BY step) AS total FROM (SELECT o_orderpriority AS step, sum(o_totalprice) AS change FROM orders GROUP BY 1))")
def waterfall(spark, d):
    return rounded(charts.waterfall(t(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 2)


@query("SELECT CAST(least(floor((l_quantity - a) / (b - a) * 20), 19) AS INT) AS i, CAST(least(floor((l_discount - c) / (e - c) * 20), 19) AS INT) AS j, count(*) AS n FROM lineitem, (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_discount) AS c, max(l_discount) AS e FROM lineitem) GROUP BY ALL")
def grid_counts(spark, d):
    return charts.grid_counts(t(spark, d, "lineitem"), "l_quantity", "l_discount")


@query("SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'numeric'), ('o_custkey', 'bigint', 'numeric'), ('o_orderstatus', 'string', 'categorical'), ('o_totalprice', 'double', 'numeric'), ('o_orderdate', 'timestamp_ntz', 'datetime'), ('o_orderpriority', 'string', 'categorical')) v(\"column\", type, \"group\")")
def column_groups(spark, d):
    return charts.column_groups(t(spark, d, "orders"))


@query("SELECT 'orders' AS name, count(*) AS row_count, 6 AS column_count, CAST(0 AS BIGINT) AS missing_values_count, CAST(0 AS BIGINT) AS duplicate_rows_count, CAST(100 AS DOUBLE) AS data_quality_score FROM orders")
def catalog_entry(spark, d):
    return catalog.entry(t(spark, d, "orders"), "orders").drop("columns_info")


@query("SELECT count(*) AS datasets, CAST(sum(n) AS BIGINT) AS total, avg(n) AS average, arg_max(name, n) AS largest FROM (SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part)")
def catalog_totals(spark, d):
    rows = catalog.entry(t(spark, d, "orders"), "orders").union(catalog.entry(t(spark, d, "part"), "part"))
    return catalog.totals(rows)

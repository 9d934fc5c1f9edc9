"""Rule-based insights and recommendations over the profile's tables, and the queries of an insight list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.functions.columns import categorical, numeric
from brinework.operators import hypothesis_tests
from brinework.operators.models import vif
from brinework.operators.profile import categorical_stats, constant_features, distribution_type, iqr_outliers, numeric_stats, overview, pearson
from brinework.operators.quality import eda_score


def facts(df: DataFrame, normality: bool = True) -> DataFrame:
    """One row of what the rules look at: overview, counts of strong and perfect pairs, of columns that others explain,
    of columns with over 5 and 10 % outliers, of high-cardinality and constant columns, and the quality score. With
    ``normality`` each number column is tested too, on a bounded sample, in two passes for all."""
    num, cat = numeric(df), categorical(df)
    o = overview(df).select("rows", "columns", "missing_percent", "duplicate_rows", "duplicate_percent", "numeric_columns")
    names = lambda hit: F.array_sort(F.collect_list(F.when(hit, F.col("column"))))
    empty = F.array().cast("array<string>")
    one = df.sparkSession.range(1)
    pairs = pearson(df, num).agg(F.count_if(F.abs("r") > 0.3).alias("strong"), F.count_if(F.abs("r") > 0.99).alias("perfect")) if len(num) > 1 else one.select(F.lit(0).alias("strong"), F.lit(0).alias("perfect"))
    explained = vif(df, num).agg(names(F.col("severity") == "high").alias("explained")) if len(num) > 1 else one.select(empty.alias("explained"))
    odd = iqr_outliers(df, num).agg(names(F.col("percent") > 5).alias("odd5"), names(F.col("percent") > 10).alias("odd10")) if num else one.select(empty.alias("odd5"), empty.alias("odd10"))
    many = categorical_stats(df, cat).agg(names(F.col("high_cardinality")).alias("many")) if cat else one.select(empty.alias("many"))
    constant = constant_features(df).agg(F.count_if(F.col("kind") == "constant").alias("constant"))
    out = o.join(pairs).join(explained).join(odd).join(many).join(constant).join(eda_score(df).select("score"))
    tested, other = 0, 0
    if normality:
        verdicts = hypothesis_tests.shapiro_verdicts(df, num).values()
        tested, other = len(num), sum(v is False for v in verdicts)
    return out.withColumn("tested", F.lit(tested)).withColumn("non_normal", F.lit(other))


def _rules(found: DataFrame, rules: list[tuple[int, str, Column, Column]]) -> DataFrame:
    rows = F.array(*(F.when(hit, F.struct(F.lit(group).alias("rank"), F.lit(kind).alias("kind"), text.alias("text"))) for group, kind, hit, text in rules))
    return found.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def insights(df: DataFrame, normality: bool = True) -> DataFrame:
    """(rank, kind, text): ten groups of rules over ``facts``, in order."""
    v, say = F.col, F.format_string
    some = lambda c, n=3: F.array_join(F.slice(c, 1, n), ", ")
    lost, dup, score = v("missing_percent"), v("duplicate_percent"), v("score")
    # The thresholds of the rules.
    rules = [
        (1, "large", v("rows") > 1_000_000, say("large dataset of %d rows: consider sampling", "rows")),
        (1, "small", v("rows") < 100, say("small dataset of %d rows: tests may lack power", "rows")),
        (1, "size", v("rows").between(100, 1_000_000), say("%d rows and %d columns suit a full analysis", "rows", "columns")),
        (2, "missing_high", lost > 20, say("%.1f%% missing: investigate patterns, impute or remove rows", lost)),
        (2, "missing_moderate", (lost > 5) & (lost <= 20), say("%.1f%% missing: impute", lost)),
        (2, "missing_low", (lost > 0) & (lost <= 5), say("%.1f%% missing: little impact", lost)),
        (3, "duplicates", dup > 5, say("%d duplicate rows, %.1f%%: remove them", "duplicate_rows", dup)),
        (4, "strong_pairs", v("strong") > 0, say("%d strong correlations", "strong")),
        (4, "perfect_pairs", v("perfect") > 0, say("%d perfect correlations: maybe the same feature twice", "perfect")),
        (5, "multicollinearity", F.size("explained") > 0, F.concat(say("%d features are explained by others: ", F.size("explained")), some("explained"))),
        (6, "outliers", F.size("odd10") > 0, F.concat(say("many outliers in %d columns: ", F.size("odd10")), some("odd10"))),
        (7, "non_normal", (v("tested") > 0) & (v("non_normal") > v("tested") * 0.7), say("%d of %d number columns are not normal: consider transformations", "non_normal", "tested")),
        (8, "quality_excellent", score >= 90, say("excellent quality, %.1f", score)),
        (8, "quality_good", (score >= 75) & (score < 90), say("good quality, %.1f", score)),
        (8, "quality_fair", (score >= 60) & (score < 75), say("fair quality, %.1f: clean before modeling", score)),
        (8, "quality_poor", score < 60, say("poor quality, %.1f: thorough cleaning needed", score)),
        (9, "cardinality", F.size("many") > 0, F.concat(F.lit("many categories in "), some("many"))),
        (10, "dimensions", v("numeric_columns") > 50, say("%d number columns: consider components or selection", "numeric_columns")),
    ]
    return _rules(facts(df, normality), rules)


def recommendations(df: DataFrame) -> DataFrame:
    """(rank, kind, text): six priorities over ``facts``, in order."""
    v, say = F.col, F.format_string
    some = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    # The thresholds of the rules.
    rules = [
        (1, "missing", v("missing_percent") > 10, F.lit("high priority: fill or drop missing values")),
        (1, "duplicates", v("duplicate_percent") > 1, say("high priority: remove %d duplicate rows", "duplicate_rows")),
        (2, "constant", v("constant") > 0, say("medium priority: remove %d constant features", "constant")),
        (2, "multicollinearity", F.size("explained") > 0, F.concat(F.lit("medium priority: remove redundant features: "), some("explained", 3))),
        (3, "outliers", F.size("odd5") > 0, F.concat(say("medium priority: investigate outliers in %d columns: ", F.size("odd5")), some("odd5", 2))),
        (4, "selection", v("strong") > 5, F.lit("low priority: components or feature selection")),
        (5, "ready", v("score") >= 90, F.lit("ready for modeling")),
        (5, "nearly_ready", (v("score") >= 75) & (v("score") < 90), F.lit("nearly ready: clean a little, cross-validate")),
        (5, "cleaning_required", v("score") < 75, F.lit("improve quality before modeling")),
        (6, "checklist", F.lit(True), F.lit("missing values, duplicates, encoding, scaling, train and test split")),
    ]
    return _rules(facts(df, normality=False), rules)


# context for a text about a dataset


def context_pairs(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b, r, strength) of pairs with |r| of ``least`` or more: strong over 0.8, else moderate."""
    return pairs.where(F.abs("r") >= least).select("a", "b", "r", F.when(F.abs("r") > 0.8, "strong").otherwise("moderate").alias("strength"))


def interesting_columns(df: DataFrame, columns: list[str] | None = None, most: int = 10) -> DataFrame:
    """(column, distribution, outlier_percent, skewed, odd) of the first ``most`` number columns that are skewed or
    heavy-tailed, or have over 5 % outliers."""
    columns = (columns or numeric(df))[:most]
    stats = numeric_stats(df, columns)
    kinds = distribution_type(stats)
    both = stats.select("column", F.try_divide(F.col("outliers") * 100.0, "count").alias("outlier_percent")).join(F.broadcast(kinds), "column")
    skewed = F.col("distribution").isin("right_skewed", "left_skewed", "heavy_tailed")
    odd = F.coalesce(F.col("outlier_percent") > 5, F.lit(False))
    return both.select("column", "distribution", "outlier_percent", skewed.alias("skewed"), odd.alias("odd")).where("skewed or odd")


# an insight list


def summary(rows: DataFrame) -> DataFrame:
    """(insight_type, n, mean_confidence, high, medium, low, helpful, not_helpful, unrated, models, latest) of an insight
    table by type."""
    c = F.col("confidence_score")
    return rows.groupBy("insight_type").agg(
        F.count("*").alias("n"), F.avg(c).alias("mean_confidence"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"),
        F.count_if("is_helpful").alias("helpful"), F.count_if(~F.col("is_helpful")).alias("not_helpful"), F.count_if(F.col("is_helpful").isNull()).alias("unrated"),
        F.count_distinct("model_used").alias("models"), F.max("created_at").alias("latest"),
    )


def listed(rows: DataFrame, kinds: list[str] | None = None, least: float = 0.0, limit: int = 50, offset: int = 0) -> DataFrame:
    """Insights of the kinds with enough confidence, most confident and newest first."""
    out = rows.where(F.col("confidence_score") >= least)
    if kinds:
        out = out.where(F.col("insight_type").isin(*kinds))
    return out.orderBy(F.desc("confidence_score"), F.desc("created_at"), "id").offset(offset).limit(limit)


def exported(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Insights as JSON lines or CSV."""
    if kind not in ("json", "csv"):
        raise ValueError("format must be json or csv")
    writer = rows.orderBy(F.desc("confidence_score"), F.desc("created_at"), "id").write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)

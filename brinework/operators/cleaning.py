"""Cleaning and feature preparation. Statistics are one aggregate each, taken at once and joined back as a single row, so
that the plan of many steps grows with their number only; "first" and "next" go by a declared key, never by a position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.functions.columns import free_name, long_form, numeric
from brinework.functions.stems import stemmed
from brinework.operators import anomaly, impute, ranges
from brinework.operators.ranks import collected, order_statistics, quantile_row, running, sizes_of


def _with_stats(df: DataFrame, stats: list[Column]) -> DataFrame:
    """``df`` with a row of statistics beside each row, taken at once; it is one row, so its broadcast is bounded."""
    return df.join(F.broadcast(collected(df.agg(*stats)))) if stats else df


# rows


#: Rows of a task, about, that groups whole rows.
GROUPED_ROWS = 500_000


def spread(df: DataFrame, group_rows: int = GROUPED_ROWS) -> DataFrame:
    """``df`` with equal rows together and about ``group_rows`` rows in a partition, whatever the session's number of
    partitions is, so that what a task holds to group them doesn't grow with the table. Groupings of all columns on end
    shuffle no more."""
    parts = ceil(df.count() / group_rows)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *df.columns) if parts > 1 else df


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, order: Sequence[str] | None = None, keep: str = "first") -> DataFrame:
    """Distinct rows, or by ``subset`` the first or last row by ``order``; ``keep`` none drops all that repeat. Nulls
    are equal to each other."""
    if not subset:
        df = spread(df)
        return df.dropDuplicates() if keep != "none" else df.groupBy(*df.columns).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    if keep == "none":
        single = df.groupBy(*subset).agg(F.count("*").alias("_n"), *(F.any_value(c).alias(c) for c in df.columns if c not in subset)).where("_n = 1")
        return single.select(*df.columns)
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c not in subset]
    # an aggregate and not a window: what repeats most is reduced before it is shuffled
    best = df.groupBy(*subset).agg(pick(F.struct(*df.columns), F.struct(*(order or rest or subset))).alias("_r"))
    return best.select(*(F.col("_r")[c].alias(c) for c in df.columns))


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.na.drop(how, subset=list(columns) if columns else None)


# missing values


def fill_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


def _modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The most common value of each column, the least of several; null for one without values. Values are counted by
    shuffle, all text columns in one pass, so no task holds all values of a column."""
    text = [c for c, k in df.dtypes if c in columns and k == "string"]
    best = lambda v: F.min_by(v, F.struct(-F.col("_n"), F.col(v)))
    out: dict[str, object] = {}
    if text:
        counts = long_form(df, text, "string").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("_n"))
        out = {c: None for c in text} | {r["column"]: r["v"] for r in counts.groupBy("column").agg(best("value").alias("v")).collect()}
    for c in columns:
        if c not in text:
            counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
            out[c] = counts.agg(best("_v")).first()[0]
    return out


def fill(df: DataFrame, numbers: str = "median", others: str = "mode", columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Nulls of number columns by their median, mean or mode, of other columns by their mode (least of the most common);
    a column without values by "Unknown" where it is text. Strategy ``live_mode`` fills numbers with the mean."""
    columns = list(columns or df.columns)
    num = set(numeric(df))
    middle = [c for c in columns if c in num] if numbers == "median" else []

    kinds = dict(df.dtypes)
    common = _modes(df, [c for c in columns if c not in middle and (others == "mode" if c not in num else numbers == "mode")])

    def stat(c):
        if c in common:
            return F.lit(common[c]).cast(kinds[c])
        return F.avg(c) if c in num else F.lit(None)

    out = _with_stats(df, [stat(c).alias(f"_fill_{i}") for i, c in enumerate(columns) if c not in middle])
    if middle:
        q = quantile_row(df, middle, (0.5,), exact)
        out = out.join(F.broadcast(q.select(*(F.col(f"_q{i}")[0].alias(f"_fill_{columns.index(c)}") for i, c in enumerate(middle)))))
    filled = {}
    for i, c in enumerate(columns):
        kind = "double" if c in num and numbers in ("mean", "live_mode", "median") else kinds[c]
        unknown = [F.lit("Unknown")] if kinds[c] == "string" else []
        filled[c] = F.coalesce(F.col(c).cast(kind), F.col(f"_fill_{i}").cast(kind), *unknown)
    return out.withColumns(filled).select(*df.columns)


def carry(df: DataFrame, column: str, order: Sequence[str], by: Sequence[str] = (), forward: bool = True, range_rows: int = ranges.RANGE_ROWS) -> DataFrame:
    """Forward or backward fill in ``order``. With ``by`` the order is within each entity; without, it is one of all rows,
    which are scanned by ranges of it."""
    if not by:
        new = free_name(df, "_known")
        return ranges.known(df, F.col(column), order, new, forward, range_rows=range_rows).withColumn(column, F.col(new)).select(*df.columns)
    till, since = ranges.both_ways(by, order, F.col(column))
    return df.withColumn(column, F.last(column, True).over(till if forward else since))


def carry_both(df: DataFrame, column: str, following: str, order: Sequence[str], range_rows: int = ranges.RANGE_ROWS) -> DataFrame:
    """Forward fill of ``column`` in one order of all rows, and its backward fill as a new column ``following``, by one pass
    over the ranges."""
    new = free_name(df, "_known")
    out = ranges.known(df, F.col(column), order, new, ahead=True, range_rows=range_rows)
    return out.withColumn(column, F.col(new)).select(*df.columns, F.col(f"{new}_ahead").alias(following))


def interpolate(df: DataFrame, column: str, at: str, by: Sequence[str] = (), range_rows: int = ranges.RANGE_ROWS) -> DataFrame:
    """Nulls between two values on the line through them by the number column ``at``; none beyond the ends. Without ``by``
    the rows are scanned by ranges of ``at``."""
    here = F.when(F.col(column).isNotNull(), F.struct(F.col(at).cast("double").alias("x"), F.col(column).cast("double").alias("y")))
    if by:
        back, ahead = ranges.both_ways(by, [at], F.col(column))
        out, a, b = df.withColumn("_a", F.last(here, True).over(back)).withColumn("_b", F.last(here, True).over(ahead)), F.col("_a"), F.col("_b")
    else:
        new = free_name(df, "_known")
        out = ranges.known(df, here, [at], new, ahead=True, range_rows=range_rows)
        a, b = F.col(new), F.col(f"{new}_ahead")
    line = a["y"] + (b["y"] - a["y"]) * F.try_divide(F.col(at) - a["x"], b["x"] - a["x"])
    return out.withColumn(column, F.coalesce(F.col(column).cast("double"), line)).select(*df.columns)


# outliers


def outlier_flags(df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 1.5, exact: bool = True, contamination: float = 0.05, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """``df`` with a boolean ``<column>_outlier`` each: beyond ``threshold`` interquartile ranges of the quartiles (iqr),
    over ``threshold`` population standard deviations from the mean (zscore), or one mask for all columns: by an isolation
    forest, or as noise of a density clustering (dbscan), nulls counting as the median. Nulls are never outliers by iqr or
    zscore."""
    columns = list(columns)
    if method in ("isolation_forest", "dbscan"):
        plain = [f"_plain_{i}" for i in range(len(columns))]
        q = quantile_row(df, columns, (0.5,), exact)
        full = df.join(F.broadcast(q)).withColumns({p: F.coalesce(F.col(c).cast("double"), F.col(f"_q{i}")[0], F.lit(0.0)) for i, (c, p) in enumerate(zip(columns, plain, strict=True))}).drop(*(f"_q{i}" for i in range(len(columns))))
        flagged = anomaly.flags(full, plain, contamination).withColumnRenamed("is_anomaly", "_odd").drop("anomaly") if method == "isolation_forest" else anomaly.dbscan_noise(full, plain, eps, min_samples, "_odd")
        return flagged.withColumns({f"{c}_outlier": F.col("_odd") for c in columns}).select(*df.columns, *(f"{c}_outlier" for c in columns))
    if method == "iqr":
        out = df.join(F.broadcast(quantile_row(df, columns, (0.25, 0.75), exact, "_s{}")))
    elif method == "zscore":
        out = _with_stats(df, [F.array(F.avg(c), F.stddev_pop(c)).alias(f"_s{i}") for i, c in enumerate(columns)])
    else:
        raise ValueError(f"no outlier method {method}")
    flags = {}
    for i, c in enumerate(columns):
        a, b, x = F.col(f"_s{i}")[0], F.col(f"_s{i}")[1], F.col(c)
        hit = (x < a - threshold * (b - a)) | (x > b + threshold * (b - a)) if method == "iqr" else (b > 0) & (F.abs(x - a) > threshold * b)
        flags[f"{c}_outlier"] = F.coalesce(hit, F.lit(False))
    return out.withColumns(flags).select(*df.columns, *flags)


def treat_outliers(df: DataFrame, columns: Sequence[str], treatment: str = "cap", method: str = "iqr", threshold: float = 1.5, value: float | None = None, exact: bool = True, **options) -> DataFrame:
    """cap: to the least and most of the values that are none; remove: the rows; winsorize: the ends of each column, if
    any row is flagged; impute: ``value`` or the median of those that are none; flag: a column each; none: as it is. The
    columns become doubles but for remove, flag and none."""
    columns = list(columns)
    if treatment == "none":
        return df
    flagged = outlier_flags(df, columns, method, threshold, exact, **options)
    if treatment == "flag":
        return flagged
    if treatment == "remove":
        return flagged.where(~reduce(lambda a, b: a | b, (F.col(f"{c}_outlier") for c in columns))).select(*df.columns)
    fair = {c: F.when(~F.col(f"{c}_outlier"), F.col(c).cast("double")) for c in columns}
    if treatment == "cap":
        out = _with_stats(flagged, [F.array(F.min(x), F.max(x)).alias(f"_t_{c}") for c, x in fair.items()])
        new = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.col(f"_t_{c}")[0]), F.col(f"_t_{c}")[1])) for c in columns}
    elif treatment == "impute":
        if value is None:
            middle = quantile_row(flagged.select(*(x.alias(c) for c, x in fair.items())), columns, (0.5,), exact)
            out = flagged.join(F.broadcast(middle.select(*(F.col(f"_q{i}")[0].alias(f"_t_{c}") for i, c in enumerate(columns)))))
        else:
            out = flagged.withColumns({f"_t_{c}": F.lit(float(value)) for c in columns})
        new = {c: F.when(F.col(f"{c}_outlier"), F.col(f"_t_{c}")).otherwise(F.col(c).cast("double")) for c in columns}
    elif treatment == "winsorize":
        any_odd = F.coalesce(F.max(reduce(lambda a, b: a | b, (F.col(f"{c}_outlier") for c in columns))), F.lit(False)).alias("_any")
        out = _with_stats(flagged, [any_odd])
        for c in columns:
            out = out.withColumn(f"_w_{c}", F.col(c).cast("double"))
            out = winsorize(out, f"_w_{c}")
        new = {c: F.when(F.col("_any"), F.col(f"_w_{c}")).otherwise(F.col(c).cast("double")) for c in columns}
    else:
        raise ValueError(f"no treatment {treatment}")
    return out.withColumns(new).select(*df.columns)


def winsorize(df: DataFrame, column: str, share: float = 0.05) -> DataFrame:
    """The lowest and highest floor(share n) values become the next value inward. The two order statistics are taken by
    brackets, so no task sorts all rows."""
    ends = order_statistics(df, [column], lambda n: [int(n * share), n - 1 - int(n * share)])[0]
    if not ends[0]:
        return df
    k = int(ends[0] * share)
    c, kind = F.col(column), dict(df.dtypes)[column]
    return df.withColumn(column, F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(ends[1][k]).cast(kind)), F.lit(ends[1][ends[0] - 1 - k]).cast(kind))))


# scaling and encoding


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """standard (population deviation), minmax, robust (median and interquartile range), maxabs, log (of 1 + x), sqrt,
    or quantile (share of smaller values); 0 where a column does not vary."""
    if method in ("log", "sqrt"):
        f = F.log1p if method == "log" else F.sqrt
        least = -1 if method == "log" else 0
        return df.withColumns({c: F.when(F.col(c) > least if method == "log" else F.col(c) >= least, f(F.col(c).cast("double"))) for c in columns})
    if method == "quantile":
        out = df
        for c in columns:
            ranked = running(sizes_of(df, c), c)
            total = ranked.agg((F.sum("n") - 1).cast("double").alias("_last"))
            place = ranked.join(F.broadcast(total)).select(F.col(c).alias("_v"), F.coalesce(F.try_divide("before", F.nullif("_last", F.lit(0.0))), F.lit(0.0)).alias("_q"))
            out = out.join(place, F.col(c) == F.col("_v"), "left").withColumn(c, F.col("_q")).drop("_v", "_q")
        return out
    x = {c: F.col(c).cast("double") for c in columns}
    out = df.join(F.broadcast(scale_parameters(df, columns, method).agg(*(F.max(F.when(F.col("column") == c, F.array("centre", "width"))).alias(f"_s_{c}") for c in columns))))
    new = {c: F.when(v.isNotNull(), F.coalesce(F.try_divide(v - F.col(f"_s_{c}")[0], F.nullif(F.col(f"_s_{c}")[1], F.lit(0.0))), F.lit(0.0))) for c, v in x.items()}
    if method == "minmax" and (low, high) != (0.0, 1.0):
        new = {c: v * (high - low) + low for c, v in new.items()}
    return out.withColumns(new).select(*df.columns)


def scale_parameters(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """(column, centre, width) that ``scale`` takes off and divides by, as a table to keep and use again."""
    columns = list(columns)
    if method == "robust":
        q = quantile_row(df, columns, (0.25, 0.5, 0.75))
        parts = [F.struct(F.lit(c).alias("column"), F.col(f"_q{i}")[1].alias("centre"), (F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]).alias("width")) for i, c in enumerate(columns)]
        return q.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    stats = {
        "standard": lambda v: (F.avg(v), F.stddev_pop(v)), "minmax": lambda v: (F.min(v), F.max(v) - F.min(v)), "maxabs": lambda v: (F.lit(0.0), F.max(F.abs(v))),
    }[method]
    one = df.agg(*(x.alias(f"_{i}_{k}") for i, c in enumerate(columns) for k, x in zip("ab", stats(F.col(c).cast("double")), strict=True)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{i}_a").alias("centre"), F.col(f"_{i}_b").alias("width")) for i, c in enumerate(columns)))).alias("p")).select("p.*")


def scale_by(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """Columns scaled by kept ``scale_parameters``, which are few and so collected; 0 where the width is 0."""
    kept = {r["column"]: (r["centre"], r["width"]) for r in parameters.collect() if r["column"] in df.columns}
    return df.withColumns({c: F.when(F.col(c).isNotNull(), (F.col(c).cast("double") - a) / b if b else F.lit(0.0)) for c, (a, b) in kept.items() if a is not None})


def code_parameters(df: DataFrame, column: str) -> DataFrame:
    """(value, code) of the sorted distinct values, as a table to keep and use again."""
    return _codes(df, column).select(F.col("_v").alias("value"), F.col("_code").cast("long").alias("code"))


def encode_by(df: DataFrame, column: str, parameters: DataFrame) -> DataFrame:
    """``column`` by kept ``code_parameters``; null for values they do not have."""
    return df.join(parameters, F.col(column).cast("string") == F.col("value"), "left").withColumn(column, F.col("code")).select(*df.columns)


def _codes(df: DataFrame, column: str) -> DataFrame:
    """(column, _code): 0, 1, ... in order of the distinct values as text, which are placed by ranges."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("_v")).distinct()
    return ranges.places(values, "_v", "_code")


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values as 0, 1, ...; null stays null."""
    return df.join(_codes(df, column), F.col(column).cast("string") == F.col("_v"), "left").withColumn(column, F.col("_code").cast("long")).select(*df.columns)


def one_hot(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """A boolean column for each sorted value but the first; as it is for more than ``most`` values. Null: all false."""
    values = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().orderBy("v").limit(most + 1).collect()]
    if len(values) > most:
        return df
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column).cast("string") == v, F.lit(False)) for v in values[1:]}).drop(column)


def ordinal_encode(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """The place of each value in ``order``; null for others."""
    known = F.create_map(*(F.lit(x) for i, v in enumerate(order) for x in (v, i)))
    return df.withColumn(column, known[F.col(column)])


def target_encode(df: DataFrame, column: str, target: str) -> DataFrame:
    """``<column>_target``: the mean of ``target`` by value; null for null. Means are joined back, not windowed, so a
    common value does not fill one task."""
    means = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.avg(target).alias(f"{column}_target"))
    return df.join(means, F.col(column) == F.col("_v"), "left").drop("_v")


def binary_encode(df: DataFrame, column: str) -> DataFrame:
    """The sorted place of each value in bits, least first: ``<column>_bit_0``...; no bits for one value."""
    n = df.agg(F.count_distinct(column)).first()[0]
    bits = ceil(log2(n)) if n > 1 else 0
    out = df.join(_codes(df, column), F.col(column).cast("string") == F.col("_v"), "left")
    return out.withColumns({f"{column}_bit_{i}": F.shiftright("_code", i).bitwiseAND(1).cast("int") for i in range(bits)}).drop("_v", "_code", column)


# types and rules

# What dates begin with, by the formats that they may be in; words for yes and no.
DATE_FORMS = {("yyyy-MM-dd",): r"^\d{4}-\d{2}-\d{2}", ("MM/dd/yyyy", "dd/MM/yyyy"): r"^\d{2}/\d{2}/\d{4}", ("MM-dd-yy", "dd-MM-yy", "MM-dd-yyyy", "dd-MM-yyyy"): r"^\d{2}-\d{2}-\d{2}"}
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1", "on"), ("false", "f", "no", "n", "0", "off")


def repair_types(df: DataFrame, date_share: float = 0.8, number_share: float = 0.9, kinds: Sequence[str] = ("date", "boolean", "number"), skip: Sequence[str] = ()) -> DataFrame:
    """String columns that hold dates, yes-no words or numbers, as such; shares are of all non-null values, found in
    one pass. What does not parse becomes null."""
    names = [c for c, k in df.dtypes if k == "string" and c not in skip]
    if not names:
        return df
    plain = {c: F.trim(F.regexp_replace(c, "[,$]", "")) for c in names}
    stats = []
    for c in names:
        low = F.lower(F.trim(c))
        forms = [F.count_if(F.col(c).rlike(p)).alias(f"d{i}") for i, p in enumerate(DATE_FORMS.values())]
        stats.append(F.struct(F.count("*").alias("rows"), F.count(c).alias("n"), *forms, F.count_if(low.isin(*TRUE_WORDS, *FALSE_WORDS)).alias("yn"), F.count_if(plain[c].try_cast("double").isNotNull()).alias("num"), F.array_size(F.collect_set(F.when(low.isin(*TRUE_WORDS, *FALSE_WORDS), low))).alias("few")).alias(c))
    found = df.agg(*stats).first()
    new = {}
    for c in names:
        s = found[c]
        if not s["n"]:
            continue
        best = max(range(len(DATE_FORMS)), key=lambda i: s[f"d{i}"])  # noqa: B023
        if "date" in kinds and s["n"] >= s["rows"] / 2 and s[f"d{best}"] > date_share * s["n"]:
            new[c] = F.coalesce(*(F.try_to_timestamp(F.trim(F.substring(c, 1, 10)), F.lit(form)) for form in list(DATE_FORMS)[best]))
        elif "boolean" in kinds and s["yn"] == s["n"] and s["few"] <= 2:
            new[c] = F.when(F.lower(F.trim(c)).isin(*TRUE_WORDS), True).when(F.lower(F.trim(c)).isin(*FALSE_WORDS), False)
        elif "number" in kinds and s["num"] > number_share * s["n"]:
            new[c] = plain[c].try_cast("double")
    return df.withColumns(new) if new else df


def convert(df: DataFrame, column: str, kind: str, errors: str = "coerce") -> DataFrame:
    """Cast ``column``: failures become null (coerce), keep the whole column (ignore), or fail (raise)."""
    kind = {"int": "long", "float": "double", "str": "string", "bool": "boolean", "datetime": "timestamp", "category": "string"}.get(kind, kind)
    if errors == "raise":
        return df.withColumn(column, F.col(column).cast(kind))
    cast = F.col(column).try_cast(kind)
    if errors == "ignore" and df.agg(F.count_if(F.col(column).isNotNull() & cast.isNull())).first()[0]:
        return df
    return df.withColumn(column, cast)


def _broken(c: str, rule: Mapping) -> list[tuple[str, Column]]:
    """The rules on the values of a column, and where a value breaks each."""
    tests = {
        "min": lambda v: F.col(c) < v,
        "max": lambda v: F.col(c) > v,
        "pattern": lambda v: ~F.coalesce(F.col(c).cast("string").rlike(f"^(?:{v})"), F.lit(False)),
        "allowed": lambda v: F.col(c).isNotNull() & ~F.col(c).isin(*v),
    }
    return [(name, test(rule[name])) for name, test in tests.items() if name in rule]


def schema_violations(df: DataFrame, rules: Mapping[str, Mapping]) -> DataFrame:
    """(column, rule, violations): missing columns, wrong types, values under min or over max, not matching a pattern
    (from the start; nulls count), or outside the allowed ones (nulls pass). One pass for all rules."""
    kinds, counts = dict(df.dtypes), []
    for c, rule in rules.items():
        if c not in kinds:
            if rule.get("required"):
                counts.append((c, "required", F.lit(1).cast("long")))
            continue
        if "type" in rule and kinds[c] != rule["type"]:
            counts.append((c, "type", F.lit(1).cast("long")))
        counts += [(c, name, F.count_if(broken)) for name, broken in _broken(c, rule)]
    if not counts:
        return df.sparkSession.createDataFrame([], "column string, rule string, violations long")
    one = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.coalesce(F.first(n), n).alias("violations") if r in ("required", "type") else n.alias("violations")) for c, r, n in counts)).alias("_v"))
    return one.select(F.explode("_v").alias("v")).select("v.*").where("violations > 0")


def violation_samples(df: DataFrame, rules: Mapping[str, Mapping], most: int = 5) -> DataFrame:
    """(column, rule, samples): the first ``most`` different values, as texts in order, that break each rule of
    ``schema_violations`` on values; a null is the text null. Values are picked out part by part, so a rule that
    everything breaks fills no task."""
    kinds = dict(df.dtypes)
    hits = [F.when(broken, F.struct(F.lit(c).alias("column"), F.lit(name).alias("rule"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("value"))) for c, rule in rules.items() if c in kinds for name, broken in _broken(c, rule)]
    if not hits:
        return df.sparkSession.createDataFrame([], "column string, rule string, samples array<string>")
    values = df.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.*").distinct()
    for part in ([F.pmod(F.xxhash64("value"), F.lit(256))], []):
        first = Window.partitionBy("column", "rule", *part).orderBy("value")
        values = values.withColumn("i", F.row_number().over(first)).where(F.col("i") <= most).drop("i")
    return values.groupBy("column", "rule").agg(F.sort_array(F.collect_list("value")).alias("samples"))


def schema_report(df: DataFrame, rules: Mapping[str, Mapping], most: int = 5) -> DataFrame:
    """``schema_violations`` with ``severity`` (error where a column is missing or a value is not allowed, else warning),
    ``fixable`` (by ``fix_schema``), ``samples`` and ``valid``: whether no column is missing, the same in every row."""
    found = schema_violations(df, rules).join(violation_samples(df, rules, most), ["column", "rule"], "left")
    missing = [c for c, rule in rules.items() if rule.get("required") and c not in df.columns]
    severity = F.when(F.col("rule").isin("required", "allowed"), "error").otherwise("warning")
    return found.withColumns({"severity": severity, "fixable": F.col("rule").isin("type", "min", "max"), "valid": F.lit(not missing)})


def fix_schema(df: DataFrame, rules: Mapping[str, Mapping]) -> DataFrame:
    """Columns cast to their types and clipped to their ranges."""
    new = {}
    for c, rule in rules.items():
        if c in df.columns:
            x = F.col(c).try_cast(rule["type"]) if "type" in rule else F.col(c)
            if "min" in rule:
                x = F.when(x.isNotNull(), F.greatest(x, F.lit(rule["min"])))
            if "max" in rule:
                x = F.when(x.isNotNull(), F.least(x, F.lit(rule["max"])))
            new[c] = x
    return df.withColumns(new) if new else df


def clean_text(df: DataFrame, column: str, lower: bool = True, letters_only: bool = False, punctuation: bool = True, stopwords: Sequence[str] = (), stem: bool = False) -> DataFrame:
    """Text in lower case, without punctuation or anything but letters, digits and spaces, without stop words, with
    single spaces, each word as its stem by Porter's rules where ``stem``."""
    x = F.lower(column) if lower else F.col(column)
    if letters_only:
        x = F.regexp_replace(x, r"[^\p{L}\p{N}\s]", "")
    elif punctuation:
        x = F.regexp_replace(x, r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", "")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    if stopwords:
        x = F.array_join(F.filter(F.split(x, " "), lambda w: ~w.isin(*stopwords)), " ")
    if stem:
        x = stemmed(x)
    return df.withColumn(column, x)


def categories(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(column, distinct, ratio) of the string columns whose distinct values are under ``threshold`` of all rows. A
    column's values are dictionary-encoded in files and caches anyway, so being a category is a fact about it, no type."""
    names = [c for c, k in df.dtypes if k == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, distinct long, ratio double")
    kinds = long_form(df, names, "string").where("value is not null").groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("distinct"))
    rows = df.agg(F.count("*").alias("_rows"))
    return kinds.join(F.broadcast(rows)).select("column", "distinct", (F.col("distinct") / F.col("_rows")).alias("ratio")).where(F.col("ratio") < threshold)


def downcast(df: DataFrame, integers: bool = True, floats: bool = True) -> DataFrame:
    """Integer columns in the least type that holds their range, and doubles as floats where none loses anything."""
    whole = [c for c, k in df.dtypes if integers and k in ("smallint", "int", "bigint")]
    broken = [c for c, k in df.dtypes if floats and k == "double"]
    if not whole and not broken:
        return df
    found = df.agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in whole), *(F.bool_and(F.isnan(c) | (F.col(c).cast("float").cast("double") == F.col(c))).alias(c) for c in broken)).first()
    new = {}
    for c in whole:
        if found[c]["lo"] is not None:
            kind = next(k for k, bits in (("byte", 7), ("short", 15), ("int", 31), ("long", 63)) if -(2**bits) <= found[c]["lo"] and found[c]["hi"] < 2**bits)
            new[c] = F.col(c).cast(kind)
    new |= {c: F.col(c).cast("float") for c in broken if found[c]}
    return df.withColumns(new) if new else df


def parse_dates(df: DataFrame, column: str, form: str | None = None, unit: str | None = None, utc_from: str | None = None) -> DataFrame:
    """``column`` as a timestamp: by ``form``, or as seconds, milliseconds or microseconds since 1970 (``unit`` s, ms or
    us), or by the first known form that fits; from the zone ``utc_from`` to UTC. What does not parse is null."""
    if unit:
        x = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}[unit](F.col(column).try_cast("long"))
    elif form:
        x = F.try_to_timestamp(column, F.lit(form))
    else:
        x = F.coalesce(*(F.try_to_timestamp(F.trim(column), F.lit(f)) for forms in DATE_FORMS for f in forms), F.col(column).try_cast("timestamp"))
    return df.withColumn(column, F.to_utc_timestamp(x, utc_from) if utc_from else x)


def standardize(df: DataFrame, column: str, how: str = "lower") -> DataFrame:
    """One form for a text column: lower, upper, title, trim, digits (only those), or spaces (single ones)."""
    x = F.col(column)
    forms = {"lower": F.lower(x), "upper": F.upper(x), "title": F.initcap(x), "trim": F.trim(x), "digits": F.regexp_replace(x, "[^0-9]", ""), "spaces": F.trim(F.regexp_replace(x, r"\s+", " "))}
    return df.withColumn(column, forms[how])


def fill_by_strategy(df: DataFrame, strategy: str = "median", per_column: Mapping[str, str] | None = None, values: Mapping[str, object] | None = None, order: Sequence[str] = (), by: Sequence[str] = (), neighbours: int = 5, rounds: int = 10) -> DataFrame:
    """Missing values by a strategy for each column: drop, median, mean, mode, forward, backward, knn or mice; given
    ``values`` first. Columns go in order, so a drop changes the statistics of those after it; statistics of columns on end
    that drop nothing are one pass. median and mean leave other columns than numbers as they are. Forward and backward go
    by ``order``, within each ``by``. knn and mice come last, each over its own columns."""
    out = df.na.fill(dict(values)) if values else df
    num, per_column = set(numeric(df)), per_column or {}
    batch: dict[str, list[str]] = {}
    last: dict[str, list[str]] = {"knn": [], "mice": []}

    def done(frame: DataFrame) -> DataFrame:
        for how, names in batch.items():
            frame = fill(frame, numbers=how, others="mode", columns=names)
        batch.clear()
        return frame

    for c in df.columns:
        how = per_column.get(c, strategy)
        if how == "drop":
            out = done(out).na.drop(subset=[c])
        elif how == "mode" or how in ("median", "mean") and c in num:
            batch.setdefault(how, []).append(c)
        elif how in ("forward", "backward"):
            if not order:
                raise ValueError(f"{how} needs an order")
            out = carry(done(out), c, order, by, forward=how == "forward")
        elif how in last and c in num:
            last[how].append(c)
        elif how not in ("median", "mean", "knn", "mice", "none"):
            raise ValueError(f"no strategy {how}")
    out = done(out)
    for how, names in last.items():  # only columns with nulls are filled, and make the space of neighbours
        if names:
            nulls = out.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in names)).first()
            last[how] = [c for c in names if nulls[c]]
    if last["knn"]:
        out = impute.knn(out, last["knn"], neighbours)
    return impute.mice(out, last["mice"], rounds=rounds) if last["mice"] else out

"""Row and column operators of data preparation: filters, merges, splits, pages, searches, sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v), "not_in": lambda c, v: ~c.isin(*v), "contains": lambda c, v: c.contains(v), "startswith": lambda c, v: c.startswith(v), "endswith": lambda c, v: c.endswith(v),
    "is_null": lambda c, v: c.isNull(), "not_null": lambda c, v: c.isNotNull(),
}


def predicate(conditions: Sequence[tuple[str, str, object]], logic: str = "and") -> Column:
    """(column, operator, value) conditions as one column; a comparison with null is false."""
    parts = [F.coalesce(OPERATORS[op](F.col(c), v), F.lit(False)) for c, op, v in conditions]
    return reduce((lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b), parts)


def filter_rows(df: DataFrame, conditions: Sequence[tuple[str, str, object]], logic: str = "and", keep: bool = True) -> DataFrame:
    p = predicate(conditions, logic)
    return df.where(p if keep else ~p)


def merge(frames: Sequence[DataFrame], on: Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Datasets joined one after the other by the same keys, of which nulls are equal to each other. Other columns that both
    sides have get ``suffixes``."""
    on = list(on)

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        both = [c for c in a.columns if c in b.columns and c not in on]
        semi = how.replace("_", "").lower() in ("semi", "leftsemi", "anti", "leftanti")
        key = {c: f"_key_{i}" for i, c in enumerate(on)}
        right = b.select(*(F.col(c).alias(key[c]) for c in on), *([] if semi else [F.col(c).alias(c + suffixes[1] if c in both else c) for c in b.columns if c not in on]))
        left = a if semi else a.withColumnsRenamed({c: c + suffixes[0] for c in both})
        out = left.join(right, [F.col(c).eqNullSafe(F.col(k)) for c, k in key.items()], how)
        # of an outer join's two keys one may be missing
        return out if semi else out.select(*(F.coalesce(c, key[c]).alias(c) for c in on), *(c for c in out.columns if c not in on and c not in key.values()))

    return reduce(two, frames)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *(c for c in df.columns if c not in first))


def split_column(df: DataFrame, column: str, separator: str, names: Sequence[str], keep: bool = True) -> DataFrame:
    """Parts of a text between a literal separator; the last name has the rest, names beyond the parts are null."""
    parts = F.split(F.col(column), "\\Q" + separator + "\\E", len(names))
    out = df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})
    return out if keep else out.drop(column)


def combine_columns(df: DataFrame, columns: Sequence[str], name: str, separator: str = " ", keep: bool = True) -> DataFrame:
    out = df.withColumn(name, F.concat_ws(separator, *columns))
    return out if keep else out.drop(*(c for c in columns if c != name))


def derive(df: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """New columns from SQL expressions."""
    return df.withColumns({n: F.expr(f) for n, f in formulas.items()})


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    return df.withColumns({f"{c}_pow_{k}": F.pow(F.col(c).cast("double"), F.lit(k)) for c in columns for k in range(2, degree + 1)})


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def date_parts(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({f"{column}_{n}": f(column) for n, f in (("year", F.year), ("month", F.month), ("day", F.day), ("weekday", F.weekday), ("hour", F.hour))})


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows with ``text`` in any of the columns, in any case; % and _ stand for themselves."""
    q = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.where(reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{q}%") for c in columns)))


def page(df: DataFrame, number: int, size: int, order: Sequence[Column | str]) -> DataFrame:
    """Page ``number`` (from 1) in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> tuple[int, int]:
    """(rows, pages)."""
    n = df.count()
    return n, ceil(n / size)


def sample(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows, the same ones each time: least seeded hash of ``key`` first, ties by the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def preview(df: DataFrame, n: int = 1000) -> DataFrame:
    return df.limit(n)

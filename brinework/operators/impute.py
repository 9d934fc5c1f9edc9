"""Imputation by models: nearest donors, and chained regressions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinework.operators.models import _moments


#: Distinct donors and incomplete rows of a range, about, ranges of a search at most, above which they get larger, and
#: distances that a task holds at once.
DONORS_A_TASK, ROWS_A_TASK, RANGES, HELD = 50_000, 20_000, 1024, 2_000_000


@dataclass(frozen=True)
class Search:
    """Incomplete rows that know the columns of one set, and donors that know those of another: the columns both have, the
    one whose order the donors are dealt by, those that the donors can fill, and the splitters of the ranges."""

    shared: list[int]
    axis: int
    fills: list[int]
    splitters: list[float]


def _first_alike(donors: pd.DataFrame, one: Search, k: int) -> pd.DataFrame:
    """``donors`` in the order of the axis; where many share a value of it only the first ``k`` by hash of those that are
    alike in the shared columns, as these are equally far from any row."""
    donors = donors.sort_values(f"_c{one.axis}", kind="stable")
    at = donors[f"_c{one.axis}"].to_numpy()
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
    if not len(at) or np.diff(np.append(starts, len(at))).max() <= 16 * k:
        return donors
    shared = [donors[f"_c{j}"].to_numpy() for j in [one.axis, *(j for j in one.shared if j != one.axis)]]
    order = np.lexsort((donors["tie"].to_numpy(), *shared[::-1]))
    new = np.append(True, np.any([v[order][1:] != v[order][:-1] for v in shared], axis=0))
    first = np.flatnonzero(new)
    return donors.iloc[order[np.arange(len(order)) - first[np.cumsum(new) - 1] < k]]


def _nearest(donors: pd.DataFrame, rows: pd.DataFrame, one: Search, p: int, k: int, bounds: bool = False) -> pd.DataFrame:
    """For each of ``rows`` the k of ``donors`` that come first by distance and hash, no farther than the row's ``bound``:
    (column, distance, tie, value, n) for each column they fill; and the k-th distance as column -1. The k-th of the donors
    beside a row in the order of the axis bounds how far along it the others need be looked for; with ``bounds`` the rows
    come back with these bounds, and no donors."""
    names, out = [f"_c{j}" for j in range(p)], []
    donors = _first_alike(donors, one, k)
    base, x = donors[names].to_numpy(dtype=np.float64), rows[[f"_q{j}" for j in range(p)]].to_numpy(dtype=np.float64)
    tie, times, at, bound = donors["tie"].to_numpy(), donors["n"].to_numpy(), base[:, one.axis], rows["bound"].to_numpy(dtype=np.float64).copy()

    def far(q: np.ndarray, d: np.ndarray) -> np.ndarray:
        total = np.zeros(d.shape)
        for c in one.shared:
            gap = x[q, c] - base[d, c]
            total += gap * gap
        return total * p / len(one.shared)

    reached = lambda q: (np.searchsorted(at, x[q, one.axis] - reach[q], "left"), np.searchsorted(at, x[q, one.axis] + reach[q], "right"))
    reach = np.sqrt(bound * len(one.shared) / p) * (1 + 1e-9)
    lo, hi = reached(slice(None))
    width = min(max(4 * k, 32), len(base))
    todo = np.flatnonzero(hi - lo > 4 * width) if width >= k else []
    while len(todo):  # more donors beside a row bound it further, as long as many more are within reach
        for i in range(0, len(todo), max(1, HELD // width)):
            q = todo[i : i + max(1, HELD // width)]
            first = np.clip(np.searchsorted(at, x[q, one.axis]) - width // 2, 0, len(base) - width)
            beside = far(q[:, None], first[:, None] + np.arange(width))
            bound[q] = np.minimum(bound[q], np.partition(beside, k - 1, axis=1)[:, k - 1])
        reach[todo] = np.sqrt(bound[todo] * len(one.shared) / p) * (1 + 1e-9)
        lo[todo], hi[todo] = reached(todo)
        todo, width = todo[hi[todo] - lo[todo] > 4 * width], min(4 * width, len(base))
    if bounds:
        return rows.assign(bound=bound)
    till, i, kth = np.cumsum(hi - lo), 0, np.full(len(x), np.inf)
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(till, (till[i - 1] if i else 0) + HELD, "right")))
        sizes = (hi - lo)[i:j]
        q = np.repeat(np.arange(i, j), sizes)
        d = np.arange(len(q)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[q]
        distance = far(q, d)
        keep = distance <= bound[q]
        q, d, distance = q[keep], d[keep], distance[keep]
        order = np.lexsort((tie[d], distance, q))
        q, d, distance = q[order], d[order], distance[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kth[q[place == k - 1]] = distance[place == k - 1]
        q, d, distance = q[place < k], d[place < k], distance[place < k]
        for c in one.fills:
            out.append(pd.DataFrame(x[q], columns=names).assign(column=c, distance=distance, tie=tie[d], value=base[d, c], n=times[d]))
        i = j
    out.append(pd.DataFrame(x, columns=names).assign(column=-1, distance=kth, tie=0, value=0.0, n=0))
    return pd.concat(out)


def knn(df: DataFrame, columns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Nulls of ``columns`` as the mean of the k nearest donors that have the column, by Euclidean distance over the
    columns both have, scaled up for those missing; the column's mean over all rows where no donor is comparable. Equal
    distances go by a seeded hash. All rows are donors: distinct incomplete rows that know the same columns search the
    distinct donors that know the same columns, dealt into ranges of a column with many values that varies most. Donors
    of a row's own range bound which ranges can hold its nearest ones, and those are searched."""
    p = len(columns)
    names, asked = [f"_c{j}" for j in range(p)], [f"_q{j}" for j in range(p)]
    clean = {n: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for n, c in zip(names, columns, strict=True)}
    lacking = F.lit(False)
    for n in names:
        lacking = lacking | F.col(n).isNull()
    work = df.withColumns(clean)
    known = F.concat(*(F.when(F.col(n).isNull(), "0").otherwise("1") for n in names))
    rows = work.groupBy(*names).agg(F.count("*").alias("n")).withColumn("tie", F.xxhash64(F.lit(seed), *names))
    aggs = [x for n in names for x in (F.sum(F.col(n) * F.col("n")).alias(n), F.stddev_pop(n).alias(f"{n}_wide"), F.approx_count_distinct(n).alias(f"{n}_many"))]
    facts = {r["known"]: r for r in rows.groupBy(known.alias("known")).agg(F.count("*").alias("rows"), F.sum("n").alias("n"), *aggs).collect()}
    having = [[m for m in facts if m[j] == "1"] for j in range(p)]
    start = {n: sum(facts[m][n] for m in own) / sum(facts[m]["n"] for m in own) if own else None for n, own in zip(names, having, strict=True)}
    pairs = []  # (what the incomplete row knows, what the donor knows and is dealt by, shared, those it can fill)
    for q in sorted(facts):
        for m in sorted(facts):
            shared, fills = [j for j in range(p) if q[j] == m[j] == "1"], [j for j in range(p) if q[j] == "0" and m[j] == "1"]
            if shared and fills:
                axis = max(shared, key=lambda j: (min(facts[m][f"{names[j]}_many"], RANGES), facts[m][f"{names[j]}_wide"]))
                pairs.append((q, (m, axis), shared, fills))
    if not pairs:
        return work.withColumns({c: F.coalesce(F.col(n), F.lit(float(start[n] or 0.0))) for n, c in zip(names, columns, strict=True)}).select(*df.columns)
    cuts = {g: 1 for _, g, _, _ in pairs}
    for q, g, _, _ in pairs:
        cuts[g] = min(RANGES, max(cuts[g], 1 + facts[g[0]]["rows"] // DONORS_A_TASK, 1 + facts[q]["rows"] // ROWS_A_TASK))
    points = [F.percentile_approx(F.when(known == m, F.col(names[axis])), F.array(*(F.lit(i / n) for i in range(1, n))), 10_000) for (m, axis), n in cuts.items() if n > 1]
    found = dict(zip([g for g, n in cuts.items() if n > 1], rows.agg(*points).first() if points else [], strict=True))
    splitters = {g: sorted(set(found.get(g) or [])) for g in cuts}
    # values that alone have more donors than a range should hold
    common = {g: sorted({v for v, n in Counter(found.get(g) or []).items() if n >= 3}) for g in cuts}
    group = {g: i for i, g in enumerate(cuts)}
    searches = [Search(shared, g[1], fills, splitters[g]) for _, g, shared, fills in pairs]
    bits = lambda m: sum(1 << j for j in range(p) if m[j] == "1")
    donor_groups = [(bits(g[0]), g[1], np.array(splitters[g]), common[g]) for g in cuts]
    wanted_by = [(bits(q), group[g]) for q, g, _, _ in pairs]

    def dealt(batches):
        for pdf in batches:
            code = pdf[names].notna().to_numpy() @ (1 << np.arange(p))
            for i, (m, axis, ends, heavy) in enumerate(donor_groups):
                some = pdf[code == m]
                at = np.searchsorted(ends, some[names[axis]])
                yield some.assign(group=i, range=at, heavy=np.isin(at, np.searchsorted(ends, heavy)))

    def sought(batches):
        for pdf in batches:
            code = pdf[asked].notna().to_numpy() @ (1 << np.arange(p))
            for i, (q, g) in enumerate(wanted_by):
                some = pdf[code == q]
                _, axis, ends, _ = donor_groups[g]
                yield some.assign(search=i, to_group=g, to_range=np.searchsorted(ends, some[asked[axis]]), bound=np.inf)

    # pandas has no null number, so what comes back as NaN is null again
    null = lambda x, over: x.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in over})
    doubles = lambda over: ", ".join(f"{n} double" for n in over)
    donors = rows.mapInPandas(dealt, f"{doubles(names)}, n long, tie long, group int, range int, heavy boolean")
    if any(common.values()):
        # donors that are alike in the shared columns are equally far, so the first k of them are enough
        by_group = {i: [j for j, (_, g) in enumerate(wanted_by) if g == i] for i in range(len(cuts))}
        copies = null(donors.where("heavy"), names).withColumn("search", F.explode(F.coalesce(*(F.when(F.col("group") == i, F.array(*map(F.lit, own))) for i, own in by_group.items()))))
        alike = [F.when(F.col("search").isin([i for i, one in enumerate(searches) if j in one.shared]), F.col(n)) for j, n in enumerate(names)]
        first = copies.withColumn("_place", F.row_number().over(Window.partitionBy("search", "range", *alike).orderBy("tie"))).where(F.col("_place") <= k).drop("_place", "search").distinct()
        donors = donors.where("not heavy").unionByName(first)
    donors = donors.drop("heavy").groupBy("group", "range")
    # new names, as a cogroup of two frames with columns of one origin mixes them up
    wanted = rows.where(lacking).select(*(F.col(n).alias(q) for n, q in zip(names, asked, strict=True))).mapInPandas(sought, f"{doubles(asked)}, search int, to_group int, to_range int, bound double")

    def bounded(key, a, b):
        out = []
        for i, some in b.groupby("search"):
            one = searches[i]
            got = _nearest(a, some, one, p, k, bounds=True)
            at, reach, ends = got[asked[one.axis]], np.sqrt(got["bound"] * len(one.shared) / p) * (1 + 1e-9), np.array(one.splitters)
            out.append(got.assign(lo=np.searchsorted(ends, at - reach), hi=np.searchsorted(ends, at + reach))[[*asked, "search", "to_group", "lo", "hi", "bound"]])
        return pd.concat(out) if out else pd.DataFrame(columns=[*asked, "search", "to_group", "lo", "hi", "bound"])

    def met(key, a, b):
        out = [_nearest(a, some, searches[i], p, k) for i, some in b.groupby("search")]
        out = [x[x["column"] >= 0] for x in out]
        return pd.concat(out) if out else pd.DataFrame(columns=[*names, "column", "distance", "tie", "value", "n"])

    ends = donors.cogroup(wanted.groupBy("to_group", "to_range")).applyInPandas(bounded, f"{doubles(asked)}, search int, to_group int, lo int, hi int, bound double")
    further = ends.withColumn("to_range", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    near = null(donors.cogroup(further.groupBy("to_group", "to_range")).applyInPandas(met, f"{doubles(names)}, column int, distance double, tie long, value double, n long"), names)
    each = Window.partitionBy(*names, "column").orderBy("distance", "tie", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = near.withColumn("before", F.sum("n").over(each) - F.col("n")).where(F.col("before") < k).withColumn("n", F.least("n", k - F.col("before")))
    means = taken.groupBy(*names, "column").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))
    fills = means.groupBy(*(F.col(n).alias(f"_k{n}") for n in names)).agg(*(F.max(F.when(F.col("column") == j, F.col("value"))).alias(f"_f{j}") for j in range(p)))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_k{n}"))
    filled = work.where(lacking).join(fills, same, "left").withColumns({c: F.coalesce(names[j], f"_f{j}", F.lit(float(start[names[j]] or 0.0))) for j, c in enumerate(columns)}).select(*df.columns)
    whole = work.where(~lacking).withColumns({c: F.col(n) for n, c in zip(names, columns, strict=True)}).select(*df.columns)
    return whole.unionByName(filled)


def mice(df: DataFrame, columns: list[str], rounds: int = 10, ridge: float = 1e-6) -> DataFrame:
    """Nulls of ``columns`` by chained ridge regressions on the others. A round needs one aggregate of column products
    for each column with nulls; the rows stay where they are and only coefficients go from round to round."""
    flags = {c: f"_was_null_{i}" for i, c in enumerate(columns)}
    start = df.agg(*(F.avg(c).alias(c) for c in columns), *(F.count_if(F.col(c).isNull()).alias(f) for c, f in flags.items())).first()
    if any(start[c] is None for c in columns):
        raise ValueError("a column without values can't be filled")
    lacking = [c for c in columns if start[flags[c]]]
    work = df.withColumns({f: F.col(c).isNull() for c, f in flags.items()}).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(start[c]))) for c in columns})
    current = {c: None for c in lacking}
    for _ in range(rounds):
        moved = 0.0
        for c in lacking:
            others = [o for o in columns if o != c]
            n, sums, cross = _moments(work.where(~F.col(flags[c])), [*others, c])
            mean = sums / max(n, 1)
            cov = cross - n * np.outer(mean, mean)
            k = len(others)
            w = np.linalg.solve(cov[:k, :k] + ridge * np.diag(np.maximum(np.diag(cov[:k, :k]), 1e-12)), cov[:k, k])
            b = float(mean[k] - w @ mean[:k])
            new = np.append(w, b)
            moved = max(moved, float(np.abs(new - current[c]).max()) if current[c] is not None else np.inf)
            current[c] = new
            line = sum((F.col(o) * float(v) for o, v in zip(others, w, strict=True)), F.lit(b))
            work = work.withColumn(c, F.when(F.col(flags[c]), line).otherwise(F.col(c)))
        if moved < 1e-6:
            break
    return work.drop(*flags.values())

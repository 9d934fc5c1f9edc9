"""Near-duplicate vectors by a robust-pruned flat graph: graphs are built on overlapping cluster shards, adjacency lists
are united by node, a greedy search from each shard's medoid widens to all nodes in range and goes on in every shard that a
node in range is in, too; recall is audited, and every link is verified in double precision."""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.llm.common import connected_components, cut, joined_by_key

log = logging.getLogger(__name__)

#: Vectors that coarse centroids are fitted on, at most, chosen by a hash of the node; every vector is indexed.
FIT_VECTORS = 10_000
#: Coarse cells of a label, at most. They only narrow down which clusters a vector is compared with; the number of clusters
#: grows with the vectors, one for about ``SHARD`` of them.
CELLS = 256
#: Vectors of a shard, about; what a task holds of a cluster, and of the queries sent to it.
SHARD = 300
#: Vectors of a cell that one task compares with the cell's clusters.
CELL_ROWS = 20_000
DEGREE, BEAM, ALPHA = 24, 32, 1.2
#: Clusters a vector is indexed in, clusters it is searched in at first, and cells whose clusters it is compared with.
OVERLAP, PROBES, NEAR_CELLS = 2, 3, 3
#: Nodes audited at random, and as many by links; recall asked for; links from which on a recall tells anything.
AUDIT, RECALL, MEASURED = 200, 0.9, 50


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit vectors by cosine."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norms = np.sqrt((sums * sums).sum(axis=1))
        c[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return c


def robust_prune(x: np.ndarray, p: int, near: np.ndarray, alpha: float, degree: int) -> list[int]:
    """Of the candidates ``near`` of ``p``, nearest first, those that no kept one is closer to by the factor alpha."""
    near = near[near != p]
    to_p = ((x[near] - x[p]) ** 2).sum(axis=1)
    order = np.lexsort((near, to_p))
    near, to_p = near[order], to_p[order]
    between = ((x[near][:, None] - x[near][None]) ** 2).sum(axis=2)
    alive, kept = np.ones(len(near), dtype=bool), []
    for i in range(len(near)):
        if not alive[i]:
            continue
        kept.append(int(near[i]))
        if len(kept) == degree:
            break
        alive &= alpha * alpha * between[i] > to_p
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[list[int]]:
    """Out-neighbours of each vector of one shard: robust-pruned from its nearest and some random ones, with edges back,
    and a ring of all vectors, so that every vector can be reached."""
    n = len(x)
    if n <= 1:
        return [[] for _ in range(n)]
    rng = np.random.default_rng(n)
    pool = min(n - 1, 2 * degree)
    graph: list[set[int]] = []
    far = rng.integers(0, n, size=(n, 8))
    for a in range(0, n, 512):
        near = np.argpartition(-(x[a : a + 512] @ x.T), pool, axis=1)[:, : pool + 1]
        for i, row in enumerate(near, a):
            graph.append(set(robust_prune(x, i, np.unique(np.concatenate([row, far[i]])), alpha, degree)))
    back: list[set[int]] = [set() for _ in range(n)]
    for i, own in enumerate(graph):
        for j in own:
            back[j].add(i)
    out = []
    for i in range(n):
        own = graph[i] | back[i]
        out.append(robust_prune(x, i, np.array(sorted(own)), alpha, degree) if len(own) > 2 * degree else sorted(own))
    ring = rng.permutation(n)
    for i, j in zip(ring, np.roll(ring, -1), strict=True):
        if int(j) != int(i) and int(j) not in out[i]:
            out[i].append(int(j))
    return out


def range_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, least: float, beam: int, seeds: np.ndarray | None = None) -> np.ndarray:
    """For each query which nodes are in range. A beam of the nearest nodes seen walks from ``start``, and from the
    query's own ``seeds`` (filled up with -1); once it stands still, all nodes in range are expanded until no new one turns
    up. ``graph``: neighbours, filled up with -1."""
    q, n = len(queries), len(x)
    x1 = np.vstack([x, np.zeros((1, x.shape[1]))])
    seen = np.zeros((q, n + 1), dtype=bool)
    sim = np.full((q, n + 1), -2.0, dtype=np.float32)
    done = np.zeros((q, n + 1), dtype=bool)
    done[:, n] = seen[:, n] = True
    seen[:, start] = True
    sim[:, start] = queries @ x[start]
    rows = np.arange(q)
    top = np.full((q, beam), n, dtype=np.int64)
    top[:, 0] = start
    for k in range(seeds.shape[1] if seeds is not None else 0):
        r = np.flatnonzero((seeds[:, k] >= 0) & (seeds[:, k] != start))
        node = seeds[r, k]
        seen[r, node] = True
        sim[r, node] = np.einsum("ij,ij->i", queries[r], x1[node])
        top[r, 1 + k] = node
    active = rows
    while len(active):
        # the nearest open node of the beam, else any open node in range
        cand = top[active]
        open_sim = np.where(done[active[:, None], cand], -3.0, sim[active[:, None], cand])
        best = np.argmax(open_sim, axis=1)
        node, has = cand[np.arange(len(active)), best], open_sim[np.arange(len(active)), best] > -2.5
        if not has.all():
            left = active[~has]
            wide = (sim[left] >= least - 1e-6) & ~done[left]
            node[~has] = np.argmax(wide, axis=1)
            has[~has] = wide.any(axis=1)
        active, node = active[has], node[has]
        if not len(active):
            break
        done[active, node] = True
        nb = graph[node]
        nb = np.where(nb < 0, n, nb)
        fresh = ~seen[active[:, None], nb]
        if fresh.any():
            r, c = np.nonzero(fresh)
            ids = nb[r, c]
            seen[active[r], ids] = True
            sim[active[r], ids] = np.einsum("ij,ij->i", queries[active[r]], x1[ids])
            pool = np.concatenate([top[active], np.where(fresh, nb, n)], axis=1)
            keep = np.argpartition(-sim[active[:, None], pool], beam - 1, axis=1)[:, :beam]
            top[active] = np.take_along_axis(pool, keep, axis=1)
    return sim[:, :n] >= least - 1e-6


def _components(hit: np.ndarray, q_ids: np.ndarray, n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id of each query's and each node's component in the bipartite graph ``hit``."""
    q, n = q_ids.astype(np.int64).copy(), n_ids.astype(np.int64).copy()
    r, c = np.nonzero(hit)
    while len(r):
        q1, n1 = q.copy(), n.copy()
        np.minimum.at(q1, r, n[c])
        np.minimum.at(n1, c, q1[r])
        if (q1 == q).all() and (n1 == n).all():
            break
        q, n = q1, n1
    return q, n


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def _graph_of(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    ids = pdf["node"].to_numpy()
    graph = build_graph(_matrix(pdf["v"]))
    return pd.DataFrame({"node": ids, "near": [ids[g].tolist() for g in graph]})


_FOUND = "kind int, node long, n long, m long, other long"


def _search_of(least: float, beam: int):
    """Kind 0: how many vectors (n) and nodes (m) of this cluster a query links to. Kind 1: links of a spanning forest.
    Kind 2: a cluster (n) that the query has not been in, and a node in range (other) is."""

    def run(key, nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        if not len(nodes) or not len(queries):
            return pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")})
        leaf = int(key[0])
        ids, x = nodes["node"].to_numpy(dtype=np.int64), _matrix(nodes["v"])
        place = {int(k): i for i, k in enumerate(ids)}
        lists = [[place[j] for j in near if j in place] for near in nodes["near"]]
        graph = np.full((len(ids), max(1, max(map(len, lists)))), -1, dtype=np.int64)
        for i, own in enumerate(lists):
            graph[i, : len(own)] = own
        medoid = int(np.argmax(x @ x.mean(axis=0)))
        first, second = nodes["first"].to_numpy(dtype=np.int64), nodes["second"].to_numpy(dtype=np.int64)
        weight, elsewhere = nodes["copies"].to_numpy(dtype=np.int64), np.where(first == leaf, second, first)
        q_ids, qx = queries["node"].to_numpy(dtype=np.int64), _matrix(queries["v"])
        seeds = np.array([[place.get(int(u), -1) for u in own] for own in queries["seeds"]], dtype=np.int64).reshape(len(q_ids), -1)
        been = {int(i): set(map(int, own)) for i, own in zip(q_ids, queries["been"], strict=True)}
        rows = []
        edges: set[tuple[int, int]] = set()
        for a in range(0, len(q_ids), 256):
            q = q_ids[a : a + 256]
            hit = range_search(x, graph, medoid, qx[a : a + 256], least, beam, seeds[a : a + 256])
            r, c = np.nonzero(hit)
            exact = np.einsum("ij,ij->i", qx[a + r], x[c])
            good = (exact >= least) & (q[r] != ids[c])
            hit[r[~good], c[~good]] = False
            own = hit & (first == leaf)  # a node is counted in its first cluster, which every search that meets it comes to
            rows += zip([0] * len(q), q.tolist(), (own @ weight).tolist(), own.sum(axis=1).tolist(), [0] * len(q), strict=True)
            r, c = r[good], c[good]
            further = pd.DataFrame({"q": q[r], "leaf": elsewhere[c], "u": ids[c]})
            further = further[further["leaf"] != leaf].groupby(["q", "leaf"], as_index=False)["u"].min()
            further = further[np.array([y not in been[i] for i, y in zip(further["q"].tolist(), further["leaf"].tolist(), strict=True)], dtype=bool)]
            rows += zip([2] * len(further), further["q"].tolist(), further["leaf"].tolist(), [0] * len(further), further["u"].tolist(), strict=True)
            q1, n1 = _components(hit, q, ids)
            edges |= {(int(i), int(j)) for i, j in zip(q, q1, strict=True) if i != j} | {(int(i), int(j)) for i, j in zip(ids, n1, strict=True) if i != j}
        rows += [(1, i, 0, 0, j) for i, j in sorted(edges)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _in_cells(cells: dict[str, np.ndarray], count: int):
    """Each row once for each of the ``count`` coarse cells that are nearest to it."""

    def run(batches):
        for pdf in batches:
            out = []
            for g, part in pdf.groupby("group", sort=False):
                c = cells.get(g)
                if c is None:
                    out.append(part.assign(cell=0))
                    continue
                order = np.argsort(-(_matrix(part["v"]) @ c.T), axis=1, kind="stable")[:, :count]
                out += [part.assign(cell=order[:, k]) for k in range(order.shape[1])]
            if out:
                yield pd.concat(out)

    return run


def _nearest_of(count: int):
    """Of the clusters of one cell the ``count`` nearest to each vector; a cell without any is a cluster of its own."""

    def run(key, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"node": [], "leaf": [], "sim": []})
        if not len(pivots):
            return pd.DataFrame({"node": rows["node"], "leaf": rows["alone"], "sim": -1.0})
        pivots = pivots.sort_values("pivot")
        sim = _matrix(rows["v"]) @ _matrix(pivots["v"]).T
        order = np.argsort(-sim, axis=1, kind="stable")[:, :count]
        k = order.shape[1]
        return pd.DataFrame({"node": np.repeat(rows["node"].to_numpy(), k), "leaf": pivots["pivot"].to_numpy()[order].ravel(), "sim": np.take_along_axis(sim, order, axis=1).ravel()})

    return run


def _fresh(df: DataFrame, *columns: str) -> DataFrame:
    """Columns under new identities, as both sides of a cogroup come from one frame."""
    return df.select(*(F.col(c).alias(c) for c in columns))


def _placed(classes: DataFrame, cells: dict[str, np.ndarray], shard: int, count: int, seed: int) -> DataFrame:
    """``classes`` with ``near``: the ``count`` nearest clusters. One node in ``shard`` is the pivot of a cluster, and stands
    in its nearest coarse cell; a node is compared with the pivots of its ``NEAR_CELLS`` nearest cells, a part of a cell's
    nodes in each task."""
    kinds = "node long, group string, v array<double>, cell int"
    narrow = classes.select("node", "group", "v")
    pivots = narrow.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(shard)) == 0).mapInPandas(_in_cells(cells, 1), kinds).select(F.col("node").alias("pivot"), "group", "v", "cell")
    rows = cut(narrow.mapInPandas(_in_cells(cells, NEAR_CELLS), kinds))
    parts = rows.groupBy("group", "cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
    key = ["group", "cell", "part"]
    alone = -1 - F.shiftrightunsigned(F.xxhash64("group", "cell"), 1)
    asked = rows.join(parts, ["group", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")).withColumn("alone", alone)
    known = pivots.join(parts, ["group", "cell"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    near = asked.select("node", "v", "alone", *key).groupBy(key).cogroup(_fresh(known, "pivot", "v", *key).groupBy(key)).applyInPandas(_nearest_of(count), "node long, leaf long, sim double")
    best = near.groupBy("node").agg(F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("sim", "leaf")), False), lambda x: x["leaf"])), 1, count).alias("near"))
    return cut(classes.join(best, "node"))


def _linked(placed: DataFrame, least: float, shard: int, probes: int, beam: int, most_rounds: int = 1000) -> DataFrame:
    """What ``_search_of`` finds, from the ``probes`` nearest clusters of each node and all that the search comes to."""
    crowd = placed.select(F.explode(F.slice("near", 1, OVERLAP)).alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    home = placed.select("node", "copies", "v", F.col("near")[0].alias("first"), F.coalesce(F.get("near", F.lit(1)), F.col("near")[0]).alias("second"), F.explode(F.slice("near", 1, OVERLAP)).alias("leaf"))
    home = cut(home.join(crowd, "leaf").withColumn("part", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")))
    graphs = home.select("leaf", "part", "node", "v").groupBy("leaf", "part").applyInPandas(_graph_of, "node long, near array<long>")
    graph = graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    nodes = cut(home.join(graph, "node"))
    none = F.array().cast("array<bigint>")
    front = cut(placed.select("node", F.explode(F.slice("near", 1, probes)).alias("leaf"), none.alias("seeds")))
    been, found = front.select("node", "leaf"), []
    for _ in range(most_rounds):
        blocks = front.groupBy("leaf").agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks"))
        key = ["leaf", "part", "block"]
        here = nodes.join(blocks, "leaf").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks", "shards")
        seen = been.groupBy("node").agg(F.collect_list("leaf").alias("been"))
        asked = front.join(placed.select("node", "v"), "node").join(seen, "node").join(blocks, "leaf").join(crowd, "leaf")
        asked = asked.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.expr("sequence(0, shards - 1)")))
        got = cut(here.groupBy(key).cogroup(_fresh(asked, "node", "v", "seeds", "been", *key).groupBy(key)).applyInPandas(_search_of(least, beam), _FOUND))
        found.append(got.where("kind < 2"))
        ahead = got.where("kind = 2").groupBy("node", F.col("n").alias("leaf")).agg(F.array(F.min("other"), F.max("other")).alias("seeds"))
        front = cut(ahead.join(been, ["node", "leaf"], "left_anti"))
        if front.isEmpty():
            break
        been = cut(been.union(front.select("node", "leaf")))
    else:
        raise RuntimeError(f"the search did not end in {most_rounds} rounds")
    return reduce(DataFrame.union, found)


def _true_links(classes: DataFrame, chosen: list, least: float) -> dict[int, int]:
    """How many nodes of its group each of the ``chosen`` (node, group, v) is linked to, by comparison with all."""
    groups = {g for _, g, _ in chosen}
    of = {g: (np.array([i for i, h, _ in chosen if h == g]), _matrix([v for _, h, v in chosen if h == g])) for g in groups}
    shared = classes.sparkSession.sparkContext.broadcast(of)

    def brute(batches):
        for pdf in batches:
            total: dict[int, int] = {}
            for g, part in pdf.groupby("group", sort=False):
                if g in shared.value:
                    ids, x = shared.value[g]
                    hit = (x @ _matrix(part["v"]).T >= least) & (ids[:, None] != part["node"].to_numpy())
                    for i, n in zip(ids.tolist(), hit.sum(axis=1).tolist(), strict=True):
                        total[i] = total.get(i, 0) + n
            yield pd.DataFrame({"node": list(total), "n": list(total.values())}).astype("int64")

    got = classes.select("node", "group", "v").mapInPandas(brute, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
    return {r["node"]: r["n"] for r in got if r["n"]}


def _recall(found: DataFrame, true: dict[int, int]) -> float:
    """The lesser of the share of all links of the audited nodes that were found, and of the mean of their shares."""
    if not true:
        return 1.0
    have = {r["node"]: r["m"] for r in found.where(F.col("kind") == 0).where(F.col("node").isin(list(true))).groupBy("node").agg(F.sum("m").alias("m")).collect()}
    got = {i: min(have.get(i, 0), n) for i, n in true.items()}
    return min(sum(got.values()) / sum(true.values()), sum(got[i] / n for i, n in true.items()) / len(true))


def _valid(v):
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) > 0, F.lit(False))


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD, probes: int = PROBES, beam: int = BEAM, seed: int = 5, audit: dict | None = None) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row: the vectors of the same label with cosine >= ``least``.

    Vectors that are null, zero, or hold null or non-finite components, and rows with a null label or id, link with
    nothing. Equal vectors of a label are one node, searched once. Vectors of another length than most of their label form
    groups of their own length. A node is indexed in its ``OVERLAP`` nearest clusters and searched in its ``probes`` nearest,
    and in every other cluster that a node in range is in. A cluster of more than ``shard`` nodes is dealt over several
    shards, and its queries over several blocks, so no task holds more of either. An audit compares at most ``AUDIT`` nodes
    at random, and as many ends of links that were found, with all of their group, each node and each link of one weight; under a recall of ``RECALL`` the search is repeated
    with twice the probes and beam, and fails if the third time it is still under it. ``audit`` gets the recall, or None where
    the audited nodes have under ``MEASURED`` links, which tell nothing. No pair is
    returned: a search yields counts and a spanning forest. Rows with one id are one vector for components, whatever their
    vectors, and keep the links of each. Other columns are ignored. Empty input: empty."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("raw"))
    good = _valid(F.col("raw")) & F.col("id").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("good", good)
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    keyed = rows.where("good").withColumn("group", F.concat_ws(":", F.size("raw"), F.col("label").cast("string"))).withColumn("tag1", F.xxhash64("group", "raw")).withColumn("tag2", F.hash("raw", "group").cast("long"))
    keyed = cut(keyed.select("id", "group", "raw", "tag1", "tag2"))
    n_rows = keyed.count()
    classes = keyed.groupBy("tag1", "tag2").agg(F.min("id").alias("head"), F.count("*").alias("copies"), F.first("group").alias("group"), F.first("raw").alias("raw"))
    classes = cut(classes.select("tag1", "tag2", "head", "copies", "group", F.transform("raw", lambda x: x / norm).alias("v")).withColumn("node", F.monotonically_increasing_id()))
    n = classes.count()
    of_rows = cut(joined_by_key(keyed.select("id", "tag1", "tag2"), classes.select("tag1", "tag2", "node", "copies", F.col("copies").alias("_size")), ["tag1", "tag2"], "_size", n_rows))

    if n:
        # coarse cells of each group, on a bounded sample; groups that it hardly meets are one cell each
        share = F.lit(int(1_000_000 * min(1.0, FIT_VECTORS / n)))
        sample = classes.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1_000_000)) < share).limit(2 * FIT_VECTORS).select("group", "v").orderBy(F.xxhash64("v")).collect()
        by_group: dict[str, list] = {}
        for r in sample:
            by_group.setdefault(r["group"], []).append(r["v"])
        cells = {g: unit(kmeans(_matrix(own), min(CELLS, len(own) // 8), seed)) for g, own in by_group.items() if len(own) >= 32 and len(own) * n / len(sample) > 4 * shard}
        true, at_random = {}, classes.orderBy(F.xxhash64("node", F.lit(seed + 1)), "node").limit(AUDIT)
        for widened in range(4):
            found = _linked(_placed(classes.select("node", "group", "copies", "v"), cells, shard, max(OVERLAP, probes), seed), least, shard, probes, beam)
            if not widened:
                # where links are rare, nodes at random have none: as many ends of links that were found are asked for all of theirs
                met = found.where("kind = 0 and m > 0").select("node").union(found.where("kind = 1").select(F.col("other").alias("node"))).distinct()
                met = met.orderBy(F.xxhash64("node", F.lit(seed + 2)), "node").limit(AUDIT).join(classes, "node").select(*classes.columns)
                chosen = {r["node"]: (r["node"], r["group"], r["v"]) for r in at_random.union(met).collect()}
                true = _true_links(classes, list(chosen.values()), least)
            recall, links = _recall(found, true), sum(true.values())
            measured = links >= MEASURED
            log.info("audited recall %.4f over %d links of %d nodes%s", recall, links, len(true), "" if measured else ": too few to measure it")
            if recall >= RECALL:
                break
            if widened == 3:
                raise RuntimeError(f"audited recall {recall:.4f} is under {RECALL}")
            probes, beam = 2 * probes, 2 * beam
        if audit is not None:
            audit |= {"recall": recall if measured else None, "nodes": len(true), "links": links, "probes": probes, "beam": beam}
        counts = found.where("kind = 0").groupBy("node").agg(F.sum("n").alias("others"))
        several = of_rows.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most")
        same = of_rows.join(several, "id").where("node > b").select(F.col("node").alias("a"), "b")
        links = cut(found.where("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b")).union(same).distinct())
        components = cut(connected_components(links)).withColumnRenamed("id", "node")
        heads = classes.select("node", "head").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least_head = heads.groupBy("component").agg(F.min("head").alias("component_id"), F.count("*").alias("_size"))
        facts = joined_by_key(heads.select("node", "component"), least_head, ["component"], "_size", n).select("node", "component_id").join(counts, "node", "left")
        facts = facts.join(classes.select("node", F.col("copies").alias("_size")), "node")
        named = joined_by_key(of_rows, facts, ["node"], "_size", n_rows)
        linked_rows = named.select("id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    else:
        linked_rows = keyed.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked_rows.union(alone)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

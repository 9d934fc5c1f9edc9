"""MinHash near-duplicate documents: universal-hash minima, banding, verification on full shingle sets, and
connected components by alternating large-star and small-star."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinework.llm.common import KEY_ROWS, LOWER, SPACES, bounded_batches, connected_components, cut, free_name, is_word_table, joined, joined_by_key, mix, passed, pieces, release, word_bounds, word_hashes

#: A pair at the threshold of 0.8 shares no band of 6 rows in 44 with probability (1 - 0.8**6)**44 = 1.6e-6; a pair
#: at 0.4 shares one with probability 0.17.
BANDS, ROWS = 44, 6
SEED = 20240611
#: Members of a bucket up to which those in different components meet pair by pair; larger buckets are compared in
#: blocks of about ``BLOCK`` members.
FEW, BLOCK = 32, 512
#: Bytes of text that are hashed at once: each minimum is taken over arrays of 8 bytes a word.
PIECE_BYTES = 500_000
#: Words of the bitmap that texts are sifted with before they are shuffled.
BITMAP = 1 << 17


def _families(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``n`` multiply-add hashes modulo 2**64."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 64, size=n, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 1 << 64, size=n, dtype=np.uint64)


def shingle_hashes(data: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, row after row, and where each row's runs start, with the end appended.
    A row of fewer words, but not none, has its whole sequence as one run."""
    starts, ends, first = word_bounds(data, rows, is_word_table(SPACES))
    h = word_hashes(data, starts, ends)
    count = np.diff(first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(runs)])
    begin = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], runs)
    length = np.repeat(np.minimum(count, n), runs)
    salt = [np.uint64(x) for x in np.random.default_rng(7).integers(0, 1 << 64, size=2 * n + 1, dtype=np.uint64)]
    out = np.zeros(at[-1], dtype=np.uint64)
    for k in range(1, n + 1):
        at_k = np.flatnonzero(length == k)
        if len(at_k):
            out[at_k] = mix(reduce(np.add, (h[begin[at_k] + i] * (salt[i] | np.uint64(1)) for i in range(k))) + salt[n + k])
    return out, at


def _signatures(shingle: int, bands: int, rows: int, seed: int):
    a, b = _families(bands * rows, seed)
    row_salt = np.random.default_rng(seed + 1).integers(0, 1 << 64, size=bands * rows, dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                data, at = joined(batch.column("text"))
                data = np.frombuffer(data.tobytes().translate(LOWER), dtype=np.uint8)
                x, runs = shingle_hashes(data, at, shingle)
                full = np.flatnonzero(np.diff(runs))
                keys = np.zeros((bands, len(full)), dtype=np.uint64)
                if len(full):
                    for k in range(bands * rows):
                        least = np.minimum.reduceat(x * a[k] + b[k], runs[full])
                        keys[k // rows] += mix(least) * row_salt[k]
                keys = mix(keys + np.arange(1, bands + 1, dtype=np.uint64)[:, None]).T
                raw, n, tag = data.tobytes(), np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.int64)
                for i in full:
                    own = np.sort(x[runs[i] : runs[i + 1]])
                    n[i] = 1 + np.count_nonzero(own[1:] != own[:-1])
                    tag[i] = np.frombuffer(hashlib.blake2b(b" ".join(raw[at[i] : at[i + 1]].split()), digest_size=16).digest(), dtype=np.int64)
                sizes = np.zeros(batch.num_rows, np.int64)
                sizes[full] = bands
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n), pa.array(tag[:, 0].copy()), pa.array(tag[:, 1].copy()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64)))],
                    names=["id", "n_shingles", "tag1", "tag2", "bands"],
                )
        release()

    return run


def shingle_set(text: str | None, n: int) -> set[bytes]:
    """The full set: distinct runs of ``n`` words, or the whole sequence where there are fewer."""
    words = (text or "").encode().translate(LOWER).split()
    if len(words) < n:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))


def _verified(shingle: int, percent: int):
    def run(batches):
        name, held = None, set()
        for batch in batches:
            keep = []
            a, b = batch.column("text_a"), batch.column("text_b")
            ids = batch.column("b").to_pylist()
            for i, key in enumerate(ids):
                if key != name:
                    name, held = key, shingle_set(b[i].as_py(), shingle)
                other = shingle_set(a[i].as_py(), shingle)
                both = len(held & other)
                keep.append(100 * both >= percent * (len(held) + len(other) - both) and bool(both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _texts_of(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The (id, text) rows of ``base`` with one of ``ids``. A bitmap of hashed ids, of fixed size however many there are,
    is broadcast first, so that few other texts are shuffled."""
    word, bit = F.pmod(F.xxhash64("id"), F.lit(BITMAP)), F.pmod(F.hash("id"), F.lit(64))
    bits = ids.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pmod(hash(id), 64))")).alias("bits"))
    sifted = base.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(bits), "word").where("shiftright(bits, bit) & 1 = 1").select("id", "text")
    # an inner join, as a semi join would be moved below the sieve
    return sifted.join(ids, "id").dropDuplicates(["id", "text"])


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are links by the words of both texts."""
    full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return full.mapInArrow(_verified(shingle, percent), "a long, b long")


def _split(members: DataFrame, n: int) -> DataFrame:
    """Members of buckets that hold several components, with the bucket's size, its largest component, and how many
    members are in others."""
    of = members.groupBy("bucket", "component").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum("k").alias("size"), F.max("k").alias("most"), F.max_by("component", F.struct("k", "component")).alias("main"))
    return joined_by_key(members, of.where("most < size").select("bucket", "size", "main", (F.col("size") - F.col("most")).alias("others"), F.col("size").alias("_size")), ["bucket"], "_size", n)


def _sets(shingle: int):
    """The hashed shingle set of each text."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                data, at = joined(batch.column("text"))
                x, runs = shingle_hashes(np.frombuffer(data.tobytes().translate(LOWER), dtype=np.uint8), at, shingle)
                own = [np.unique(x[i:j]) for i, j in zip(runs[:-1], runs[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(o) for o in own])])
                flat = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "shingles"])
        release()

    return run


def _crossing(percent: int):
    """Links between the rows of role 0 and those of role 1 of one group that are in different components: for each
    row of role 0 and each component it is linked to, one. Sets are counted a slice of shingles at a time."""

    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        ids, comp = table.column("id").to_numpy(), table.column("component").to_numpy()
        sets = table.column("shingles").combine_chunks()
        flat, ends = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        size = np.diff(ends)
        owner = np.repeat(np.arange(len(ids)), size)
        x, y = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        shared = np.intersect1d(flat[role[owner] == 0], flat[role[owner] == 1])
        place = np.searchsorted(shared, flat)
        known = place < len(shared)
        known[known] = shared[place[known]] == flat[known]
        row_of = np.zeros(len(ids), dtype=np.int64)
        row_of[x], row_of[y] = np.arange(len(x)), np.arange(len(y))
        both = np.zeros((len(x), len(y)), dtype=np.float32)
        for lo in range(0, len(shared), 4096):
            here = known & (place >= lo) & (place < lo + 4096)
            parts = []
            for k, m in ((0, len(x)), (1, len(y))):
                at = np.flatnonzero(here & (role[owner] == k))
                part = np.zeros((m, 4096), dtype=np.float32)
                part[row_of[owner[at]], place[at] - lo] = 1
                parts.append(part)
            both += parts[0] @ parts[1].T
        union = size[x][:, None] + size[y][None, :] - both
        hit = (100 * both >= percent * union) & (both > 0) & (comp[x][:, None] != comp[y][None, :])
        r, c = np.nonzero(hit)
        found = {(int(i), int(comp[y[j]])): (int(ids[x[i]]), int(ids[y[j]])) for i, j in zip(r, c, strict=True)}
        ab = [(max(p), min(p)) for p in found.values()]
        return pa.table({"a": pa.array([p[0] for p in ab], pa.int64()), "b": pa.array([p[1] for p in ab], pa.int64())})

    return run


def _apart(members: DataFrame, texts: DataFrame, shingle: int, percent: int, n: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of members of one bucket that are in different components and may be links; of several pairs from
    one member to one component, one at least if any of them is a link. And the frames that were cut for it.

    A shingle that no other open document has is shared with none, which bounds what two documents can share and ends
    most members at once. Small buckets then give their pairs. Large ones are compared within tasks: blocks of the
    members outside the largest component against blocks of all, by counts of equal hashed shingles."""
    ids = members.select("id").distinct()
    sets = cut(texts.join(ids, "id").mapInArrow(_sets(shingle), "id long, shingles array<long>"))
    each = sets.select("id", F.explode("shingles").alias("s"))
    common = cut(each.groupBy("s").agg(F.count("*").alias("_size")).where("_size > 1"))
    n_shingles = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    shared = joined_by_key(each, common, ["s"], "_size", n_shingles).groupBy("id").agg(F.count("*").alias("c"))
    live = members.select("bucket", "id", "n", "component").join(shared, "id").where(f"100 * c >= {percent} * n")
    live = cut(_split(live, n))
    passed(common)
    fits = F.expr(f"component <> other.component and 100 * least(c, other.c) >= {percent} * (n + other.n - least(c, other.c))")
    few = live.where(f"size <= {FEW}")
    pairs = few.join(few.select("bucket", F.struct("id", "n", "c", "component").alias("other")), "bucket").where("id > other.id").where(fits).select(F.col("id").alias("a"), F.col("other.id").alias("b"))

    many = live.where(f"size > {FEW}").withColumns({"ni": F.ceil(F.col("others") / BLOCK), "nj": F.ceil(F.col("size") / BLOCK)})
    spread = lambda df, own, n_own, other, n_other, role: df.withColumn(own, F.pmod(F.xxhash64("id"), F.col(n_own))).withColumn(other, F.explode(F.expr(f"sequence(0L, {n_other} - 1)"))).select("bucket", "i", "j", F.lit(role).alias("role"), "id", "component")
    blocks = spread(many.where("component <> main"), "i", "ni", "j", "nj", 0).union(spread(many, "j", "nj", "i", "ni", 1))
    found = blocks.join(sets, "id").groupBy("bucket", "i", "j").applyInArrow(_crossing(percent), "a long, b long")
    return pairs.union(found).distinct(), [sets, live]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of ``docs``.

    Words are runs of other bytes than white space, A-Z lower-cased. Two documents are linked when
    100 * shared shingles >= ``percent`` * all their shingles. Exact copies of a word sequence form a class first,
    so only class representatives (least id) are banded. Within a bucket the members first meet its centre, the member
    that shares buckets with most others. Members that are in different components afterwards are compared too, unless
    a bound rules a link out, so no candidate stays unchecked.

    Null or wordless texts: n_shingles 0, linked with nothing, kept. Rows with one id are one node, whatever their
    texts, and link what each of them links. Null ids are linked with nothing (component_id null, kept true). Other
    columns of ``docs`` are ignored. Empty input: empty."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(base.mapInArrow(_signatures(shingle, bands, rows, seed), "id long, n_shingles long, tag1 long, tag2 long, bands array<long>"))
    found = signed.where("n_shingles > 0 and id is not null")
    n_rows = signed.count()
    heads = found.groupBy("tag1", "tag2").agg(F.min("id").alias("head"), F.count("*").alias("_size"))
    headed = cut(joined_by_key(found.drop("bands"), heads, ["tag1", "tag2"], "_size", n_rows))
    # one id with several texts: the heads of all its texts are one
    several = headed.groupBy("id").agg(F.min("head").alias("v"), F.max("head").alias("most")).where("v < most").select("id", "v")
    same = cut(headed.join(several, "id").where("head > v").select(F.col("head").alias("a"), F.col("v").alias("b")).distinct())
    banded = found.join(headed.where("id = head").select("id").distinct(), "id", "left_semi").select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    common = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = common.withColumn("_size", F.col("size"))
    members = cut(joined_by_key(banded, shared, ["bucket"], "_size", n_rows * bands).distinct())
    n_open = members.count()
    # only rows without words are asked for again, not all their bands
    alone = cut(signed.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    passed(signed)
    links = same
    if n_open:
        # each bucket's centre, the member that shares buckets with most others, against its other members
        score = members.groupBy("id").agg(F.sum("size").alias("score"))
        open_ = cut(members.join(score, "id"), n_open)
        texts = cut(_texts_of(base, members.select("id").distinct()))
        passed(members)
        best = Window.partitionBy("bucket").orderBy(F.desc("score"), "id")
        centres = open_.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("bucket", F.struct("id", "n").alias("centre"), F.col("size").alias("_size"))
        near = F.expr(f"id <> centre.id and 100 * least(n, centre.n) >= {percent} * greatest(n, centre.n)")
        pairs = joined_by_key(open_, centres, ["bucket"], "_size", n_open).where(near).select(F.greatest("id", "centre.id").alias("a"), F.least("id", "centre.id").alias("b")).distinct()
        links = cut(_confirmed(pairs, texts, shingle, percent)).union(same)
        components = cut(connected_components(links))
        left = open_.drop("score", "size").join(centres.select("bucket", F.col("centre.id").alias("id")), ["bucket", "id"], "left_anti").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
        left = cut(_split(left, n_open), n_open)
        passed(open_)
        if not left.isEmpty():
            pairs, used = _apart(left, texts, shingle, percent, n_open)
            more = cut(_confirmed(pairs, texts, shingle, percent))
            passed(*used)
            links, earlier = links.union(more), components
            components = cut(connected_components(links))
            passed(earlier)
        passed(texts, left)
    else:
        components = connected_components(links)

    # a text with many copies is listed even where its component is its own, so that its rows are known for a hot key
    moved = headed.groupBy("head").agg(F.count("*").alias("_size")).join(components.select(F.col("id").alias("head"), "component"), "head", "left").where(f"component <> head or _size > {KEY_ROWS}")
    named = joined_by_key(headed.select("id", "n_shingles", "head"), moved, ["head"], "_size", n_rows, "left")
    named = named.select("id", "n_shingles", F.coalesce("component", "head").alias("component_id"))
    out = named.union(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` less all but one document of each near-duplicate group; columns stay as they are.
    Rows that repeat an id keep one row of it; rows with a null id stay."""
    classes = near_duplicates(docs, id_col, text_col, **options)
    gone_id = free_name(docs, "_gone")
    gone = classes.where("not kept").select(F.col(id_col).alias(gone_id)).distinct()
    left = docs.join(gone, docs[id_col] == gone[gone_id], "left_anti")
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return left
    return left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).union(left.where(F.col(id_col).isNull()))

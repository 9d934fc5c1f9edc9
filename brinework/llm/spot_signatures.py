"""SpotSigs fingerprints, in DataFrame functions only: after each common word (an anchor) of a text, the next content words
form a chain, and the set of a text's chains is its fingerprint. Texts are compared by the Jaccard likeness of these sets;
for near copies, sets are partitioned by length, so that only neighbours meet, and a pair that sizes rule out isn't counted."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.llm.common import connected_components, cut, free_name

#: Anchors: the commonest function words of some languages.
ANCHORS = """
a an and are as at be by for from in is it of on that the this to was with
das dem den der des die ein eine für im ist mit nicht sich und von zu auf als
au avec dans de du en est et la le les ou par pas pour que qui sur un une
al con del el es las los lo no por se su una y para
""".split()

#: Content words of a chain.
CHAIN = 2

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_signatures(df: DataFrame, text_col: str, name: str, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with ``name``: the sorted distinct 64-bit signatures of ``text_col``.

    A signature hashes an anchor and the ``chain`` content words after it, fewer at the end of the text; an anchor with none
    after it has no signature. The start of a text is an anchor too, so that any content word gives a signature. A text of
    anchors only has one signature, of all its words; one without words (null, empty, signs only) has none."""
    own = {k: free_name(df, f"_spot_{k}") for k in ("words", "content", "at")}
    words, content, at = (F.col(own[k]) for k in ("words", "content", "at"))
    step = df.withColumn(own["words"], F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0)))
    # places of the anchors among all words; j anchors come before the j-th, so its place less j content words do
    step = step.withColumn(own["at"], F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull()))
    step = step.withColumn(own["content"], F.filter(words, lambda w: ~w.isin(anchors)))
    spots = F.filter(F.transform(at, lambda p, j: F.when(p - j < F.size(content), F.xxhash64(words[p], F.slice(content, p - j + 1, chain)))), lambda s: s.isNotNull())
    found = F.when(F.size(content) > 0, F.concat(spots, F.array(F.xxhash64(F.lit(""), F.slice(content, 1, chain))))).when(F.size(words) > 0, F.array(F.xxhash64(F.lit(""), words))).otherwise(F.slice(spots, 1, 0))
    return step.withColumn(name, F.sort_array(F.array_distinct(found))).drop(*own.values())


def fingerprint(signatures: Column) -> Column:
    """A set of signatures as text, 16 hex digits for each in ascending order."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s), 16, "0")), "")


def likeness(a: Column, b: Column, percent: int = 0) -> Column:
    """Jaccard likeness of two sets of signatures, from 0 to 1; two empty sets are alike. Where the sizes alone show that it
    is under ``percent`` hundredths, it is 0 and the sets aren't gone through."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when((small == 0) | (100 * small < percent * large), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


#: Bytes of text and rows of a place in the order of ids, about, whichever is reached first; places at most, as their bounds
#: are part of the plan. Beyond that places get larger, and are sorted with spilling.
PLACE_BYTES, PLACE_ROWS, PLACES, FAN = 16_000_000, 1000, 4096, 64


def _places(docs: DataFrame, id_col: str, text_col: str) -> list[int]:
    """First ids of the places in descending order of ids, beginning with the greatest."""
    points = F.array(*(F.lit(i / PLACES) for i in range(1, PLACES)))
    key = F.col(id_col).cast("long")
    rows, size, most, found = docs.agg(F.count("*"), F.sum(F.octet_length(text_col)), F.max(key), F.percentile_approx(key, points)).first()
    if most is None:
        return []
    n = min(PLACES, max(1, ceil((size or 0) / PLACE_BYTES), ceil(rows / PLACE_ROWS)))
    return sorted({most, *(found[(i * PLACES) // n - 1] for i in range(1, n))}, reverse=True)


def with_next(docs: DataFrame, id_col: str, text_col: str, next_col: str, signed: str | None = None) -> DataFrame:
    """(id, text, next text) of all documents, where the next one in descending order of ids is meant, and the first one
    after the last. Null ids come last, and rows of one id stand by their text. With ``signed``, that column holds the
    signatures of the text and ``signed + "_next"`` those of the next text.

    Texts are shuffled once, by places between quantiles of the ids; the first document of a place is also a guest at the
    end of the place before it, so that no place needs a look into another."""
    firsts = _places(docs, id_col, text_col)
    key, n = F.col(id_col).cast("long"), max(1, len(firsts))
    if firsts:
        groups = [firsts[i : i + FAN] for i in range(0, n, FAN)]
        literal = lambda xs: "array(" + ",".join(f"cast('{x}' as bigint)" for x in xs) + ")"
        heads, all_ = F.expr(literal([g[0] for g in groups])), F.expr("array(" + ",".join(map(literal, groups)) + ")")
        group = F.size(F.filter(heads, lambda b: b >= key)) - 1
        inner = F.size(F.filter(F.get(all_, group), lambda b: b >= key)) - 1
        place = F.when(key.isNull(), n - 1).otherwise(group * FAN + inner)
        first = F.coalesce(F.get(F.get(all_, group), inner) == key, F.lit(False))
    else:
        place, first = F.lit(0), F.lit(True)
    at = F.array(F.struct(place.alias("place"), F.lit(False).alias("guest")))
    also = F.array(F.struct(F.pmod(place - 1, F.lit(n)).alias("place"), F.lit(True).alias("guest")))
    dealt = docs.select(key.alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.explode(F.when(first, F.concat(at, also)).otherwise(at)).alias("_at"))
    dealt = dealt.select("_id", "_text", "_at.place", "_at.guest").repartition("place")
    if signed:
        dealt = with_signatures(dealt, "_text", "_set")
    order = Window.partitionBy("place").orderBy("guest", F.col("_id").desc_nulls_last(), "_text")
    out = dealt.withColumn("_next", F.lead("_text").over(order))
    if signed:
        out = out.withColumn("_next_set", F.lead("_set").over(order))
    signs = [F.col("_set").alias(signed), F.col("_next_set").alias(f"{signed}_next")] if signed else []
    return out.where("not guest").select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), F.col("_next").alias(next_col), *signs)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edited, signatures, signatures_next, signatures_edited): each document, whose id is an integer, with the
    text in which the last half of its code points is replaced by as many of the first ones of the next document (all, if
    that has fewer), and the signatures of the text, of the next text and of the edited one. A null text is empty."""
    both = with_next(docs, id_col, text_col, "_after", "signatures")
    half = F.floor(F.length(text_col) / 2).cast("int")
    edited = F.concat(F.substring(F.col(text_col), F.lit(1), F.length(text_col) - half), F.substring(F.col("_after"), F.lit(1), half))
    return with_signatures(both.withColumn("edited", edited).drop("_after"), "edited", "signatures_edited")


def _bounds(percent: int) -> list[int]:
    """First sizes of the length partitions: sizes two partitions apart are too different to be ``percent`` alike."""
    out = [1]
    while out[-1] < 2**30:
        out.append(100 * out[-1] // percent + 1)
    return out


#: Signatures that are common in a sample come last in the order of a set, so that they bring few sets together. The sample
#: is of 1 id in SAMPLE_OF, and at most COMMON of them are told to all tasks. Only the work depends on it, no result does.
SAMPLE_OF, COMMON = 16, 10_000


def near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_signatures, class_id, kept) of all documents: those whose signature sets are at least ``percent`` alike are
    linked, ``class_id`` is the smallest id reachable by links, itself included, and ``kept`` marks one row of each id that
    equals it. Texts without signatures are linked with nothing. Ids are integers; rows of one id are one node, and null ids
    have no class.

    Equal sets are one node from the start. Sets are dealt to partitions of lengths and to the first signatures of an order
    in which common ones come last: two sets that are alike share one of these, in one partition or neighbouring ones. Each
    set first meets the smallest id of its group; those not linked with it by then meet the others of the group."""
    signed = with_signatures(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")), "_text", "signs").drop("_text")
    signed = cut(signed.withColumn("same", F.sha2(fingerprint(F.col("signs")).cast("binary"), 256)))
    sets = signed.where("id is not null and size(signs) > 0").groupBy("same").agg(F.min("id").alias("rep"), F.first("signs").alias("signs"))
    sets = cut(sets.withColumn("n", F.size("signs")))
    members = signed.where("id is not null and size(signs) > 0").select("id", "same").join(sets.select("same", "rep"), "same").select("id", "rep").distinct()
    sample = sets.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE_OF)) == 0).select(F.explode("signs").alias("sign")).groupBy("sign").count()
    common = [r.sign for r in sample.where("count > 2").orderBy(F.desc("count")).limit(COMMON).collect()]
    told = F.broadcast(sets.sparkSession.createDataFrame([(common,)], "common array<long>"))
    need = F.ceil(F.col("n") * percent / F.lit(100)).cast("int")
    ordered = F.concat(F.array_except("signs", "common"), F.array_intersect("signs", "common"))
    first = sets.crossJoin(told).select("rep", "n", F.slice(ordered, F.lit(1), F.col("n") - need + 1).alias("first"))
    bounds = F.array(*(F.lit(b) for b in _bounds(percent)))
    part = F.size(F.filter(bounds, lambda b: b <= F.col("n")))
    # a set is at home in its partition, and a guest in the next one, whose sets may be a little longer
    dealt = first.select("rep", "n", F.explode("first").alias("sign"), part.alias("own"))
    dealt = dealt.select("rep", "n", "sign", "own", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("part"))
    group = Window.partitionBy("sign", "part")
    home = F.col("own") == F.col("part")
    dealt = dealt.select("rep", "n", "sign", "part", home.alias("home"), F.min("rep").over(group).alias("centre"), F.max(home).over(group).alias("used"), F.count("*").over(group).alias("size"))
    dealt = cut(dealt.where("size > 1 and used").drop("used", "size"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sets are alike."""
        a, b = (sets.select(F.col("rep").alias(k), F.col("signs").alias(f"signs_{k}")) for k in "ab")
        met = pairs.where("a <> b").distinct().join(a, "a").join(b, "b")
        alike = likeness(F.col("signs_a"), F.col("signs_b"), percent)
        shared = F.size(F.array_intersect("signs_a", "signs_b"))
        return met.where((alike > 0) & (100 * shared >= percent * (F.size("signs_a") + F.size("signs_b") - shared))).select("a", "b")

    links = cut(linked(dealt.select(F.col("centre").alias("a"), F.col("rep").alias("b"))))
    classes = connected_components(links)
    # those that aren't in their centre's class by now meet the others, at home or as guests
    known = dealt.join(classes.select(F.col("id").alias("rep"), F.col("component").alias("c")), "rep", "left").join(classes.select(F.col("id").alias("centre"), F.col("component").alias("d")), "centre", "left")
    known = cut(known.select("rep", "n", "sign", "part", "home", F.coalesce("c", "rep").alias("c"), (F.coalesce("c", "rep") == F.coalesce("d", "centre")).alias("with_centre")))
    x, y = known.where("not with_centre").alias("x"), known.alias("y")
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    met = x.join(y, ["sign", "part"]).where((F.col("x.c") != F.col("y.c")) & (F.col("x.home") | F.col("y.home")) & (100 * small >= percent * large))
    more = linked(met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")))
    same_id = members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    classes = connected_components(links.unionByName(more).unionByName(same_id))
    out = signed.join(classes.withColumnRenamed("component", "class_id"), "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    return out.select(F.col("id").alias(id_col), F.size("signs").cast("long").alias("n_signatures"), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept"))

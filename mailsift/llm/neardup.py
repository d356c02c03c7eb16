"""MinHash near-dedup of multisets: BagMinHash signatures, banding, exact verification, classes.

A document is the multiset of its five-word shingles (A-Z in lower case). Two documents are linked
where their weighted Jaccard similarity, sum of minima over sum of maxima, is 0.8 or more.

BagMinHash: an element of weight w owns the strip [0, w) of a Poisson process in (weight, time) of
unit density whose points also name one of m signature places. The strip is cut at weights 1, 2, 4,
8, ...; each interval has its own seeded process, and points above w in the last one are thinned
out, so documents share the points of the weight they share. A place keeps its earliest point;
two signatures agree in a place with a probability that is exactly the weighted Jaccard similarity.
Points are drawn up to a time by which all places should be filled, and further where one isn't.

Candidates, without all pairs of a group and without caps:

1. documents of equal words (by a 128-bit BLAKE2 digest of them) form one representative; only
   representatives go on;
2. each band bucket proposes its members to its most central one, which shares its bands with the most
   documents (in a family of copies that is the text that was copied); proposals are verified exactly
   and links contracted to components;
3. buckets of at most ``SMALL`` members that still hold several components propose all pairs of members
   from different components;
4. members of larger such buckets go through an exact prefix-filtered join: shingles are ordered by
   rarity among these documents (as a table of ``CELLS`` counts by hash knows it; any one order is
   right), two documents of similarity ``similarity`` must share one of their rarest few (a share of
   1 - similarity of them), and lengths and places of the shared shingle bound the overlap that is
   possible, before pairs of different components are verified.

Defined cases: documents without words (null, empty) are classes of their own; 1 to 4 words make one
shingle; rows that agree in doc_id and text are one document and share their class; a null doc_id counts as the smallest; ids that aren't whole numbers
raise a TypeError. class_id is the smallest doc_id of the class. Other columns, whatever their
names and types, come through in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, batches, cut, digests, keyed, map_batches, mix, packed, shingles, table, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
SMALL, CELLS = 16, 1 << 20
#: Bits of a table that tells most documents without company from the others: 2 MB, at any size of the corpus.
MARKS = 1 << 24


def bags(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles of all texts, in the order of texts."""
    low = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    hashes, bounds = word_hashes(low, offsets)
    value, owner = shingles(hashes, bounds, k, whole=True)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(value)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 2**53


def bagminhash(owner: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """n signatures of m places; all zero for texts without elements."""
    levels = np.ceil(np.log2(count)).astype(int) + 1 if len(count) else np.zeros(0, int)  # intervals [0,1), [1,2), [2,4), ...
    levels[count == 1] = 1
    element = np.repeat(np.arange(len(count)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    lower = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level <= 1, 1.0, 2.0 ** (level - 1))
    seed, doc, weight = mix(value[element] + mix(level.astype(np.uint64))), owner[element], count[element].astype(float)
    total = np.bincount(owner, count, minlength=n)
    signature = np.zeros((n, m), np.uint64)
    todo, limit = total > 0, np.where(total > 0, m * (np.log(m) + 4) / np.maximum(total, 1), 0)
    while todo.any():
        live = np.flatnonzero(todo[doc])
        s, d, time = seed[live], doc[live], np.zeros(len(live))
        best, name, step = np.full(n * m, np.inf), np.zeros(n * m, np.uint64), 0
        lo, wi, we = lower[live], width[live], weight[live]
        while len(s):
            step += 1
            r = mix(s + np.uint64(step * 0xD1342543DE82EF95 % 2**64))
            time = time - np.log(_uniform(r)) / wi
            keep = time <= limit[d]
            s, d, time, lo, wi, we, r = (x[keep] for x in (s, d, time, lo, wi, we, r))
            q = mix(r ^ np.uint64(0xA24BAED4963EE407))
            hit = lo + wi * (_uniform(mix(q)) - 2.0**-54) < we
            at = d[hit] * m + (q[hit] % np.uint64(m)).astype(np.int64)
            t, p = time[hit], r[hit]
            np.minimum.at(best, at, t)
            now = t == best[at]
            name[at[now]] = p[now]
        full = np.isfinite(best).reshape(n, m).all(axis=1) & todo
        signature[full] = name.reshape(n, m)[full]
        todo &= ~full
        limit = limit * 2
    return signature


def signatures(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """Per row: keys, number of shingles, a 128-bit digest of its words, and its band hashes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            d, h = part.column("_d"), part.column("_h")
            for i, j, data, offsets in batches(part.column("_text")):
                n = j - i
                low = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
                raw = low.tobytes()
                names = digests((b" ".join(raw[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), 16)
                owner, value, count = bags(data, offsets)
                sign = bagminhash(owner, value, count, n, bands * per_band).reshape(n, bands, per_band)
                key = np.zeros((n, bands), np.uint64)
                for k in range(per_band):
                    key = mix(key * np.uint64(3) + sign[:, :, k])
                key = mix(key + np.arange(bands, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel()))
                size = np.bincount(owner, count, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([d.slice(i, n), h.slice(i, n), pa.array(size), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in names.T), lists], ["_d", "_h", "size", "w1", "w2", "bands"])

    return map_batches(rows.select("_d", "_h", "_text"), run, "_d long, _h long, size long, w1 long, w2 long, bands array<long>")


def _cell(d: str, h: str) -> Column:
    return F.pmod(F.xxhash64(d, h), F.lit(MARKS)).cast("int").alias("cell")


def marks(ids: DataFrame) -> np.ndarray:
    """One bit for each class of hashes of (id): whether an id is in it."""
    cells = ids.select(_cell("id.d", "id.h"))
    found = cells.groupBy(F.shiftright("cell", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cell & 63))").alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def shingle_sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items) of the documents in ids, once each: their shingles, each occurrence with its number, as 64-bit hashes.

    Texts are passed over where they are read, by marks of ids, so that none is shuffled; what is marked by
    chance goes in the join by ids.
    """
    shared = rows.sparkSession.sparkContext.broadcast(marks(ids))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cell = part.column("cell").to_numpy()
            part = part.filter(pa.array((shared.value[cell >> 6] >> (cell & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            d, h = part.column("_d"), part.column("_h")
            for i, j, data, offsets in batches(part.column("_text")):
                owner, value, count = bags(data, offsets)
                number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                items = mix(np.repeat(value, count) + mix(number.astype(np.uint64)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, count, minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([d.slice(i, j - i), h.slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(items.view(np.int64)))], ["d", "h", "items"])

    sets = map_batches(rows.select("_d", "_h", "_text", _cell("_d", "_h")), run, "d long, h long, items array<long>").select(F.struct("d", "h").alias("id"), "items")
    return sets.join(ids, "id", "left_semi").dropDuplicates(["id"])


def components(links: DataFrame) -> DataFrame:
    """(id, class): each linked node and the smallest node of its component, by star contractions.

    Large and small stars alternate until nothing changes. Only minima are gathered at a node, so a
    node with many links is no burden; each round ends in a table.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        edges = cut(small, "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("class")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct())
        mark = now


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """(_d, _h, class struct<d, h>): the keys of each distinct (doc_id, text) and its class."""
    rows = keyed(docs).select("_d", "_h", "_text")
    signed = cut(signatures(rows, bands, per_band).withColumn("id", F.struct(F.col("_d").alias("d"), F.col("_h").alias("h"))), "signed")
    filled = signed.filter("size > 0")
    # Sums that are joined back go to a table first: then both sides of the join are plain shuffles, and a hot key can be split.
    same = cut(filled.groupBy("w1", "w2").agg(F.min("id").alias("rep")), "same")
    reps = filled.join(same, ["w1", "w2"]).filter("id = rep").dropDuplicates(["id"]).select("id", "size", "bands")
    # A bucket of one proposes nothing: only buckets with company go on.
    spread = reps.select("id", "size", F.explode("bands").alias("key"))
    buckets = cut(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    central = spread.join(buckets, "key").groupBy("id").agg(F.min("size").alias("size"), F.sum("n").alias("company"), F.collect_list(F.struct("key", "n")).alias("k"))
    members = cut(central.select("id", "size", "company", F.explode("k").alias("k")).select("k.key", "k.n", "id", "size", "company"), "members")
    heads = cut(members.groupBy("key").agg(F.min(F.struct((-F.col("company")).alias("c"), "id", "size")).alias("head")), "heads")
    fits = lambda a, b: (F.least(a, b) >= similarity * F.greatest(a, b))
    star = members.join(heads, "key").filter((F.col("id") != F.col("head.id")) & fits(F.col("size"), F.col("head.size")))
    star = cut(star.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b")).distinct(), "star")
    # Sets of documents in company, read once and kept as a table: every verification takes them from there.
    sets = cut(shingle_sets(rows, members.select("id").distinct()), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        x = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        x = x.withColumn("common", F.size(F.array_intersect("x", "y")))
        return cut(x.filter(F.col("common") >= similarity * (F.size("x") + F.size("y") - F.col("common")) - 1e-9).select("a", "b"), name)

    links = verified(star, "links")
    known = cut(components(links), "classes")

    def labelled(known: DataFrame, these: DataFrame) -> DataFrame:
        return these.join(known, "id", "left").withColumn("class", F.coalesce("class", "id"))

    def split_buckets(these: DataFrame) -> DataFrame:
        """Of (key, id, size, class): rows of buckets with more than one class, with the bucket's count n."""
        open_ = these.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("c1"), F.max("class").alias("c2")).filter("c1 != c2").select("key", "n")
        return these.join(open_, "key")

    def all_pairs(these: DataFrame) -> DataFrame:
        """Pairs of different classes in buckets of at most SMALL members."""
        few = these.filter(F.col("n") <= SMALL)
        x, y = (few.select("key", F.col("id").alias(i), F.col("class").alias(f"c{i}"), F.col("size").alias(f"s{i}")) for i in "ab")
        return x.join(y, "key").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits(F.col("sa"), F.col("sb"))).select("a", "b").distinct()

    rest = cut(split_buckets(labelled(known, members.select("key", "id", "size"))), "rest")
    more = [all_pairs(rest)]
    crowd = rest.filter(F.col("n") > SMALL)
    if crowd.limit(1).count():
        big = cut(crowd.select("id", "class").distinct(), "big")
        more.append(rare_pairs(big.join(sets, "id"), similarity))
    pairs = more[0]
    for x in more[1:]:
        pairs = pairs.unionByName(x)
    # A table first: where few pairs are left, its size tells Spark to send them to the sets, which then stay where they are.
    pairs = cut(pairs.distinct().join(star, ["a", "b"], "left_anti"), "pairs")
    found = verified(pairs, "more-links")
    if found.limit(1).count():
        known = components(links.unionByName(found))
    classes = signed.select("_d", "_h", "id", "w1", "w2", "size").join(same, ["w1", "w2"], "left")
    classes = classes.withColumn("rep", F.when(F.col("size") > 0, F.col("rep")).otherwise(F.col("id"))).select("_d", "_h", F.col("rep").alias("id"))
    return labelled(known, classes).select("_d", "_h", "class").dropDuplicates(["_d", "_h"])


def rarity(sets: DataFrame) -> np.ndarray:
    """How often shingles occur in (items), by hash in ``CELLS`` cells: a bounded table, summed in the tasks first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS, np.int64)
        for part in parts:
            sums += np.bincount(part.column("items").flatten().to_numpy().view(np.uint64) % np.uint64(CELLS), minlength=CELLS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["cell", "n"])

    found = map_batches(sets.select("items"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def rare_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of documents from different classes whose similarity may reach the limit; of (id, class, items).

    Two sets of s and t items with Jaccard similarity of at least ``similarity`` share ``need`` = similarity / (1 + similarity)
    (s + t) items, so in any common order they share one of the first s - similarity s + 1 and t - similarity t + 1.
    """
    shared = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            items = part.column("items").flatten().to_numpy().view(np.uint64)
            size = np.array([len(x) for x in part.column("items")], np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((items, shared.value[items % np.uint64(CELLS)], owner))
            at = np.arange(len(items)) - (np.cumsum(size) - size)[owner]
            keep = at < (size - np.ceil(size * similarity - 1e-9).astype(np.int64) + 1)[owner]
            who = owner[keep]
            columns = [part.column(x).take(pa.array(who)) for x in ("id", "class")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size[who].astype(np.int32)), pa.array(at[keep].astype(np.int32)), pa.array(items[order][keep].view(np.int64))], ["id", "class", "s", "at", "item"])

    node = "struct<d:bigint,h:bigint>"
    heads = cut(map_batches(sets.select("id", "class", "items"), run, f"id {node}, class {node}, s int, at int, item long"), "heads")
    # A member of a shingle's largest class needs no look at its own class: only the others look at all.
    sizes = heads.groupBy("item", "class").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("item").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "class")).alias("m")).filter("classes > 1")
    most = cut(most.select("item", F.col("m.class").alias("most")), "most")
    mixed = cut(heads.join(most, "item"), "mixed")
    x, y = (mixed.select("item", "most", F.col("id").alias(i), F.col("class").alias(f"c{i}"), F.col("s").alias(f"s{i}"), F.col("at").alias(f"p{i}")) for i in "ab")
    need = similarity / (1 + similarity) * (F.col("sa") + F.col("sb")) - 1e-9
    good = (F.col("ca") != F.col("cb")) & (F.least("sa", "sb") >= similarity * F.greatest("sa", "sb") - 1e-9)
    # A pair is found by the first shingle it shares: before that nothing is shared, so no more can be than what stands
    # from there on in either order. By shingles that it shares later it need not be found again.
    reach = F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb"))
    pairs = x.filter("ca != most").drop("most").join(y.drop("most"), "item").filter(good & (reach >= need))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mark_near(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: row (all its columns), class_id, the smallest doc_id of its class, and is_first, whether it is the one to stay."""
    marked = _marked(docs, **options)
    return marked.select("row", F.when(F.col("c.d") != NO_ID, F.col("c.d")).alias("class_id"), _is_first().alias("is_first"))


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The row of each class that is to stay, one only of rows that agree in doc_id and text."""
    # The join has dealt and sorted the rows by these keys already.
    return _marked(docs, **options).filter(_is_first()).dropDuplicates(["_d", "_h"]).select("row.*")


def _is_first() -> Column:
    return (F.col("c.d") == F.col("_d")) & (F.col("c.h") == F.col("_h"))


def _marked(docs: DataFrame, **options) -> DataFrame:
    classes = near_classes(docs, **options).select("_d", "_h", F.col("class").alias("c"))
    return packed(docs).join(classes, ["_d", "_h"], "left")


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its class of near copies."""
    out = mark_near(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "class_id", "is_first")

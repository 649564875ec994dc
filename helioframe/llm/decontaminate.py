"""Benchmark decontamination in DataFrame functions only.

An item is contained in a document if some window of the document, as many words long as the item, has a weighted
Jaccard similarity of its 5-word shingles (weights: how often each occurs) of at least 0.8. Windows and items get a
SimHash of 64 bits. A multi-index over four blocks of 16 bits finds every window fingerprint within RADIUS bits of an
item of its size: 20 differing bits cannot be 5 or more in each of the blocks, so one block lies within 4 flips of
the item's. Exact similarity verifies what the index finds. Fingerprints of a similarity of just 0.8 differ in 9.7 bits
(deviation 2.9), so one in some 3,000 such pairs lies beyond the radius, and fewer of any closer ones; for a document
of 4 of an item's 5 shingles, the extreme case, it is one in 120.

Which windows are fingerprinted: a similar window holds at least 0.8 of the item's shingles, so at least one of the
item's rarest few (its seeds). Windows without a seed of an item of their size are left out, which loses nothing.
The others of a document form runs; bit counts of all windows of a run come from running sums over its shingles.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.common import drop, join_hot, stage, unused, where_late

SHINGLE, SIMILARITY, RADIUS, BLOCK_BITS = 5, 0.8, 19, 16
BLOCKS = 64 // BLOCK_BITS
#: Up to so many seeds are a constant in the scan; up to BROADCAST_SEEDS (16 bytes each) they are broadcast; beyond, joined.
CONSTANT_SEEDS, BROADCAST_SEEDS, BROADCAST_PROBES = 4096, 1_000_000, 300_000
#: Windows of one run that are fingerprinted together; longer runs are cut.
PIECE = 8192
_FLIPS = [sum(1 << b for b in flip) for r in range(RADIUS // BLOCKS + 1) for flip in combinations(range(BLOCK_BITS), r)]


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; null texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(hashes: Column, n: int) -> Column:
    """64-bit hashes of the n-word shingles, from the hashes of the words."""
    count = F.greatest(F.size(hashes) - (n - 1), F.lit(0))
    return F.transform(F.slice(hashes, 1, count), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, n)]))


def _bits(counts: list[Column], stride: int, n: Column) -> Column:
    """The fingerprint of n hashes from packed counts: count i holds bits i, i + stride, ..., each in `stride` bits."""
    of = lambda b: F.shiftrightunsigned(counts[b % stride], b // stride * stride).bitwiseAND((1 << stride) - 1)
    one = lambda b: F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
    return reduce(lambda x, y: x.bitwiseOR(y), [F.when(2 * of(b) > n, one(b)).otherwise(F.lit(0).cast("long")) for b in range(64)])


def _packed(h: Column, stride: int) -> list[Column]:
    """A hash as summands of packed counts."""
    mask = sum(1 << b for b in range(0, 64, stride))
    return [F.shiftrightunsigned(h, i).bitwiseAND(F.lit(mask).cast("long")) for i in range(stride)]


def weighted_similarity(a: Column, b: Column, distinct: Column) -> Column:
    """Sum of the lesser over sum of the greater counts of the hashes in two arrays. If either holds each hash once
    (`distinct`: b does), the lesser counts are 1."""
    count = lambda xs, v: F.size(F.filter(xs, lambda y: y == v))
    shared = F.array_intersect(a, b)
    plain = distinct | (F.size(F.array_distinct(a)) == F.size(a))
    both = F.when(plain, F.size(shared)).otherwise(F.aggregate(shared, F.lit(0), lambda s, v: s + F.least(count(a, v), count(b, v))))
    return both / (F.size(a) + F.size(b) - both)


def _items(benchmark: DataFrame) -> DataFrame:
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).where("size(w) > 0")
    return words.withColumn("k", F.least(F.lit(SHINGLE), F.size("w")))  # a few rows; staged before they are used


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, text_hash) of each document and item it contains, by its best window (the first of equals).

    start is the window's first word. Items of fewer than five words are one shingle of all their words; items without
    a word match nothing; items that share an id count by the best of them. Documents shorter than an item are one
    window. Null texts contain nothing; rows with a null or repeated doc_id are reported by that doc_id and the hash of
    their text, rows equal in both once. Empty tables give an empty result. More columns are ignored.
    """
    items = stage(_items(benchmark), "items")
    sizes = [r[0] for r in items.select("k").distinct().orderBy("k").collect()]  # five at most
    found = [_contaminated(docs, items.where(F.col("k") == k), k) for k in sizes]
    drop(items)
    if not found:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).cast("long").alias("text_hash")).where("false")
    return reduce(DataFrame.unionByName, found)


def _contaminated(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    item = items.select("item_id", shingles(F.col("w"), k).alias("s"))
    item = stage(item.select("item_id", "s", F.size("s").alias("m"), F.xxhash64("item_id", "s").alias("item")).dropDuplicates(["item_id", "item"]), "item-shingles")
    seeds = stage(_seeds(item), "seeds")
    runs, held = _runs(docs, seeds, k)
    windows = stage(fingerprints(runs, item.agg(F.max("m")).first()[0]), "windows")
    pairs = near(windows, item)
    found = stage(_verified(pairs, runs, item), "verified", [item, seeds, held, runs])
    drop(windows)
    return found


def _seeds(item: DataFrame) -> DataFrame:
    """(m, h): of each item of m shingles so many of the rarest among items that no similar window lacks them all."""
    every = item.select("item", "m", F.explode("s").alias("h"))
    common = every.groupBy("h").agg(F.count_distinct("item").alias("df"))
    ranked = every.join(common, "h").groupBy("item", "m").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("r"))  # one item's shingles
    need = F.col("m") - F.ceil(F.col("m") * SIMILARITY - 1e-9) + 1  # right for windows of any length
    return ranked.select("m", F.explode(F.slice("r", 1, F.least(F.col("m"), need.cast("int")))).alias("x")).select("m", F.col("x.h").alias("h")).distinct()


def _runs(docs: DataFrame, seeds: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, m, low, size, span, region): the windows of `size` shingles that start at low to low + span
    and hold a seed of an item of m shingles, with the shingles they lie in; and the staged texts it is read from."""
    n_seeds = seeds.count()
    words = F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), words.alias("w"))
    rows = rows.select("doc_id", "text_hash", shingles(F.col("w"), k).alias("s"))
    if n_seeds <= CONSTANT_SEEDS:
        values = [r[0] for r in seeds.select("h").distinct().collect()]
        held = where_late(rows, F.arrays_overlap("s", F.from_json(F.lit(str(values)), "array<bigint>")))
    else:
        keys = seeds.select("h").distinct()
        hit = rows.select("doc_id", "text_hash", F.explode("s").alias("h")).join(F.broadcast(keys) if n_seeds <= BROADCAST_SEEDS else keys, "h", "left_semi")
        hit = stage(hit.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct(), "hit")
        held = rows.join(hit, rows.doc_id.eqNullSafe(hit.d) & (rows.text_hash == hit.t), "left_semi")
    held = held.dropDuplicates(["doc_id", "text_hash"]).withColumn("row", F.monotonically_increasing_id())
    held = stage(held, "held")

    at = held.select("row", F.size("s").alias("n"), F.posexplode("s").alias("pos", "h")).join(F.broadcast(seeds) if n_seeds <= BROADCAST_SEEDS else seeds, "h")
    along = Window.partitionBy("row", "m").orderBy("pos")
    at = at.withColumn("before", F.lag("pos").over(along))
    at = at.withColumn("run", F.sum(F.when(F.col("pos") - F.col("before") <= F.col("m"), 0).otherwise(1)).over(along))
    ends = at.groupBy("row", "m", "n", "run").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    size = F.least("m", "n")
    ends = ends.select("row", "m", size.alias("size"), F.greatest(F.lit(0), F.col("a") - F.col("m") + 1).alias("from"), F.least(F.col("b"), F.col("n") - size).alias("to"))
    ends = ends.select("row", "m", "size", "to", F.explode(F.sequence("from", F.greatest("from", "to"), F.lit(PIECE))).alias("low"))
    ends = ends.withColumn("span", F.least(F.lit(PIECE - 1), F.col("to") - F.col("low")))
    region = F.slice("s", F.col("low") + 1, F.col("span") + F.col("size"))
    return stage(ends.join(held, "row").select("doc_id", "text_hash", "m", "low", "size", "span", region.alias("region")), "runs"), held


def fingerprints(runs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, text_hash, m, low, start, fp) of every window of the runs; `longest` is the greatest m.

    With P(j) the bit counts of a region's first j shingles, those of the window at i are P(i + size) - P(i). Each P(j)
    is handed to the two windows that need it. Counts are packed, four to a number where they fit.
    """
    stride = 16 if longest + PIECE < 1 << 15 else 32
    key = ["doc_id", "text_hash", "m", "low"]
    rows = runs.select(*key, "size", "span", F.posexplode("region").alias("j", "h"))
    along = Window.partitionBy(*key).orderBy("j")
    sums = [F.sum(c).over(along).alias(f"p{i}") for i, c in enumerate(_packed(F.col("h"), stride))]
    uses = F.array(F.struct((F.col("j") - F.col("size") + 1).alias("i"), F.lit(1).cast("long").alias("sign")), F.struct((F.col("j") + 1).alias("i"), F.lit(-1).cast("long").alias("sign")))
    used = rows.select(*key, "size", "span", uses.alias("uses"), *sums)
    used = used.select(*key, "size", "span", F.explode("uses").alias("u"), *[f"p{i}" for i in range(stride)]).where("u.i BETWEEN 0 AND span")
    counts = used.groupBy(*key, "size", "u.i").agg(*[F.sum(F.col(f"p{i}") * F.col("u.sign")).alias(f"c{i}") for i in range(stride)])
    return counts.select(*key, (F.col("low") + F.col("i")).alias("start"), _bits([F.col(f"c{i}") for i in range(stride)], stride, F.col("size")).alias("fp"))


def _blocks(df: DataFrame) -> DataFrame:
    value = lambda b: F.shiftrightunsigned("fp", BLOCK_BITS * b).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    return df.withColumn("x", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), value(b).alias("v")) for b in range(BLOCKS)])))


def near(windows: DataFrame, item: DataFrame) -> DataFrame:
    """windows (m, fp, ...) with `item`: each item of their size whose fingerprint lies within RADIUS bits.

    Equal fingerprints are looked up once. Items probe the ball of each of their blocks; windows wait at their own.
    """
    packed = [F.sum(c).alias(f"c{i}") for i, c in enumerate(_packed(F.col("h"), 32))]
    prints = item.select("item", "m", F.explode("s").alias("h")).groupBy("item", "m").agg(*packed)
    prints = prints.select("item", "m", _bits([F.col(f"c{i}") for i in range(32)], 32, F.col("m")).alias("fp"))
    flips = F.from_json(F.lit(str(_FLIPS)), "array<int>")
    probes = _blocks(prints).select("item", "m", F.col("fp").alias("ifp"), "x.b", F.explode(F.transform(flips, lambda f: F.col("x.v").bitwiseXOR(f))).alias("v"))
    own = stage(windows.groupBy("m", "fp").agg(F.count("*").alias("n")), "prints")
    total = own.agg(F.sum("n")).first()[0] or 0
    few = prints.count() * len(_FLIPS) * BLOCKS <= BROADCAST_PROBES
    met = _blocks(own).select("m", "fp", "n", "x.b", "x.v").join(probes.hint("broadcast" if few else "merge"), ["m", "b", "v"])  # sizes of exploded rows are not estimated
    met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
    met = stage(met.groupBy("m", "fp", "n").agg(F.collect_set("item").alias("items")), "near", [own])
    return join_hot(windows, met, ["m", "fp"], "n", total).withColumn("item", F.explode("items")).drop("items")


def _verified(pairs: DataFrame, runs: DataFrame, item: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, text_hash) of documents and items by their best window, if it is similar enough."""
    key = ["doc_id", "text_hash", "m", "low"]
    starts = pairs.groupBy(*key, "item").agg(F.array_sort(F.collect_list("start")).alias("starts"))  # PIECE at most
    region = runs.select(*[F.col(c).alias("r_" + c) for c in key], "size", "region")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("r_" + c)) for c in key])
    few = (item.agg(F.sum("m")).first()[0] or 0) <= BROADCAST_SEEDS
    own = item.select("item", "item_id", "s", (F.size(F.array_distinct("s")) == F.size("s")).alias("once"))
    both = starts.join(region, same).join(F.broadcast(own) if few else own, "item")
    window = lambda i: F.slice("region", i - F.col("low") + 1, F.col("size"))
    scored = F.transform("starts", lambda i: F.struct(weighted_similarity(window(i), F.col("s"), F.col("once")).alias("similarity"), (-i).alias("at")))
    best = both.select("doc_id", "text_hash", "item_id", F.array_max(scored).alias("best"))
    best = best.groupBy("doc_id", "text_hash", "item_id").agg(F.max("best").alias("best")).where(F.col("best.similarity") >= SIMILARITY)
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.at")).alias("start"), "text_hash")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).select("doc_id", "item_id", "similarity", "start")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no item, with their columns; null texts and rows without an id are judged like all others."""
    id_, hash_, d, t = unused(docs.columns, "__id", "__hash", "__d", "__t")
    bad = stage(contaminated(docs, benchmark).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t)).distinct(), "contaminated")
    rows = docs.withColumns({id_: F.col("doc_id").cast("long"), hash_: F.xxhash64(F.col("text").cast("string"))})
    few = bad.count() <= BROADCAST_SEEDS
    return rows.join(F.broadcast(bad) if few else bad, F.col(id_).eqNullSafe(F.col(d)) & (F.col(hash_) == F.col(t)), "left_anti").select(docs.columns)

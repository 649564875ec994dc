"""SimHash near-duplicates under a Hamming radius, found by the generalised pigeonhole principle.

Bits that agree with one another are grouped into partitions; a dynamic programme gives each partition its own
threshold so that the thresholds plus one sum to the radius plus one. Two fingerprints within the radius then
lie within the threshold in at least one partition, so probing each partition's ball finds every pair, whatever
the partitions are; they only decide the cost. Candidates are verified on all 64 bits. A bucket that holds very many
fingerprints is planned once more on the bits outside its partition, where its pairs differ by the radius at most.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import components, drop, join_hot, ship, stage, unused

SEED, SHINGLE, RADIUS, BITS = 42, 4, 4, 64
#: Fingerprints that the planner looks at (least by hash); any plan finds all pairs.
PLAN_SAMPLE = 3000
#: Rows of one bucket that one task compares; larger buckets are dealt as pairs of blocks.
BLOCK = 2048
#: Rows of one bucket from which it is planned again on the other bits.
REPLAN = 16 * BLOCK
#: Up to this many rows, a bucket gives its links as they are (at most this many per row); beyond, a spanning forest.
SMALL = 32
#: Up to so many removed rows (some 60 bytes each) are broadcast; beyond, they are joined by a shuffle of the documents.
BROADCAST_ROWS = 2_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text: unweighted bits of XXH64 over word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size + 1) - 1
        starts, ends = (stop - size)[: len(words) - shingle + 1].tolist(), stop[shingle - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 14):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)])], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        fps = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row of docs; null and blank texts have fingerprint zero."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def ball(bits: int, radius: int) -> int:
    return sum(comb(bits, r) for r in range(radius + 1)) if radius >= 0 else 0


def plan(sample: np.ndarray, rows: int, radius: int = RADIUS, own: list[int] | None = None) -> list[tuple[list[int], int]]:
    """Partitions of the bits (all, or `own`) with their thresholds (-1: not probed), cheapest on what the sample lets expect.

    Bits are ordered so that each follows the one it agrees with most, and cut into m equal runs. A partition's
    cost at threshold e is what it sends (one key and the ball of probes for each row) and the candidate pairs
    expected from the sample, at least those of independent bits. The thresholds of each m come from a dynamic
    programme over the sum of threshold + 1; the cheapest m wins.
    """
    own, bits = own or list(range(BITS)), len(own or range(BITS))
    x = ((sample.view(np.uint64)[:, None] >> np.array(own, np.uint64)) & np.uint64(1)).astype(np.float64)
    centred = x - x.mean(axis=0) if len(x) else x
    norm = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    alike = np.abs(centred.T @ centred) / np.outer(norm, norm) if len(x) else np.eye(bits)
    order, left = [0], set(range(1, bits))
    while left:
        order.append(max(sorted(left), key=lambda b: alike[order[-1], b]))
        left.discard(order[-1])
    best: tuple[float, list] = (np.inf, [])
    some = sample.view(np.uint64)[:1500]
    for m in range(1, radius + 2):
        parts = [sorted(own[b] for b in p) for p in np.array_split(np.array(order), m)]
        cost = np.zeros((m, radius + 2))
        for i, p in enumerate(parts):
            mask = np.uint64(sum(1 << b for b in p))
            if len(some) > 1:
                near = np.bitwise_count((some[:, None] ^ some[None, :]) & mask)[np.triu_indices(len(some), 1)]
                share = np.cumsum(np.bincount(near, minlength=radius + 1)[: radius + 1]) / len(near)
            else:
                share = np.ones(radius + 1)
            for e in range(radius + 1):
                wide = ball(len(p), e)
                cost[i, e + 1] = rows * wide * 1.0 + max(share[e], wide / 2.0 ** len(p)) * rows * rows / 2 * 0.01
        least = np.full((m + 1, radius + 2), np.inf)
        least[0, 0], took = 0, {}
        for i in range(m):
            for have in range(radius + 2):
                for take in range(radius + 2 - have):
                    if (c := least[i, have] + cost[i, take]) < least[i + 1, have + take]:
                        least[i + 1, have + take] = c
                        took[i + 1, have + take] = take
        if least[m, radius + 1] < best[0]:
            at, out = radius + 1, []
            for i in range(m, 0, -1):
                out.append((parts[i - 1], took[i, at] - 1))
                at -= took[i, at]
            best = (least[m, radius + 1], out[::-1])
    return best[1]


def _masks(plan_) -> list[tuple[np.uint64, list[np.uint64]]]:
    """Of each probed partition its bits, and what turns a key into the other keys of its ball."""
    word = lambda bits: np.uint64(sum(1 << b for b in bits))
    return [(word(p), [word(flip) for r in range(1, e + 1) for flip in combinations(p, r)]) for p, e in plan_ if e >= 0]


#: Rows of a bucket by kind: own key, and key probed. Two rows of one kind above OWN need not meet.
OWN, PROBE, PASSIVE = 0, 1, 2


def _keys(masks):
    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k, (mask, flips) in enumerate(masks):
                for flip in [np.uint64(0), *flips]:
                    kind = np.full(len(fp), PROBE if flip else OWN, np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(((fp & mask) ^ flip).view(np.int64)), pa.array(fp.view(np.int64)), pa.array(kind)], names=["part", "key", "fp", "kind"])

    return run


def _keys_inside(masks_of):
    """Keys inside large buckets (part, bucket, fp, kind): rows with their own key probe the balls, the others wait there."""

    def run(batches):
        for batch in batches:
            part, bucket, fp, kind = (batch.column(c).to_numpy() for c in ("part", "bucket", "fp", "kind"))
            for k, masks in enumerate(masks_of):
                for own in (True, False):
                    at = np.flatnonzero((part == k) & ((kind == OWN) == own))
                    x, g = fp[at].view(np.uint64), bucket[at]
                    for j, (mask, flips) in enumerate(masks if len(at) else []):
                        for flip in [np.uint64(0), *(flips if own else ())]:
                            now = np.full(len(at), (PROBE if flip else OWN) if own else PASSIVE, np.int8)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j, np.int32)), pa.array(g), pa.array(((x & mask) ^ flip).view(np.int64)), pa.array(x.view(np.int64)), pa.array(now)], names=["part", "bucket", "key", "fp", "kind"])

    return run


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, root) that connect what links within the radius connect among these fingerprints."""
    fp = np.unique(fp)
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(front), 256):
                f = front[at : at + 256]
                hit |= (np.bitwise_count(fp[left][:, None] ^ fp[f][None, :]) <= radius).any(axis=1)
            front, left = left[hit], left[~hit]
            a.append(fp[front])
            b.append(np.full(len(front), fp[root]))
    none = np.empty(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _links(radius: int):
    def of(rows: list[np.ndarray]):
        """Links of whole buckets, rows sorted by bucket: small ones by comparing shifted rows, others one at a time."""
        bucket, fp, kind = rows
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = np.diff(np.r_[first, len(bucket)])
        small = np.repeat(size <= SMALL, size)
        a, b = [], []
        x, g, p = fp[small], bucket[small], kind[small]
        for d in range(1, min(SMALL, len(x))):
            same = g[d:] == g[:-d]
            if not same.any():
                break
            near = np.flatnonzero(same & ((p[d:] != p[:-d]) | (p[d:] == OWN)) & (np.bitwise_count(x[d:] ^ x[:-d]) <= radius))
            a.append(x[d:][near])
            b.append(x[:-d][near])
        for i in np.flatnonzero(size > SMALL):
            at = slice(first[i], first[i] + size[i])
            u, v = _forest(fp[at], radius)
            a.append(u)
            b.append(v)
        none = np.empty(0, np.uint64)
        a, b = np.concatenate(a or [none]).view(np.int64), np.concatenate(b or [none]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("kind").to_numpy()]
            rows = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if last:
                yield of([x[:last] for x in rows])
            held = [x[last:] for x in rows]
        if held is not None and len(held[0]):
            yield of(held)

    return run


def _dealt(keyed: DataFrame, at: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """(bucket, fp, kind) of rows with keys `at`, and what was staged for it. A key of more than BLOCK rows is cut into
    blocks by hash, and each pair of blocks is a bucket of its own, so that no task holds more than two blocks of it."""
    large = keyed.groupBy(*at).count().where(F.col("count") > BLOCK).select(*at, F.ceil(F.col("count") / (BLOCK / 2)).cast("int").alias("blocks"))
    large = stage(large, "large")
    if (n := large.count()) == 0:
        return keyed.select(F.xxhash64(*at).alias("bucket"), "fp", "kind"), [large]
    both = keyed.join(F.broadcast(large) if n <= 50_000 else large, at, "left")  # 20 bytes each; beyond, a join that adaptive execution splits
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    both = both.withColumn("block", F.coalesce(block, F.lit(0))).withColumn("other", F.explode(other))
    return both.select(F.xxhash64(*at, F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), "fp", "kind"), [large]


def links(distinct: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between distinct fingerprints (fp) that connect all that lie within the radius of one another, and
    the staged tables that they are read from.

    A bucket of more than REPLAN rows is indexed once more: outside its partition's bits, two of its rows differ by the
    radius at most, so the other bits are planned in the same way. Buckets of more than BLOCK rows are dealt as pairs
    of blocks. Each task emits at most one link for each row it reads beyond SMALL rows. Two buckets with one hash only
    share a comparison; every link is verified on all bits.
    """
    spark = distinct.sparkSession
    rows = distinct.count()
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()], np.int64)
    ship(spark)
    parts = [x for x in plan(sample, rows, radius) if x[1] >= 0]
    keyed = stage(distinct.mapInArrow(_keys(_masks(parts)), "part int, key long, fp long, kind byte"), "keyed")
    held = [keyed]
    huge = keyed.groupBy("part", "key").count().where(F.col("count") > REPLAN).select("part", "key")
    huge = stage(huge, "huge")
    if (n := huge.count()) == 0:
        drop(huge)
        dealt, more = _dealt(keyed, ["part", "key"])
    else:
        held.append(huge)
        few = F.broadcast(huge) if n <= 50_000 else huge
        again = [_masks(plan(sample, REPLAN, radius, [b for b in range(BITS) if b not in p])) for p, _ in parts]
        inside = keyed.join(few, ["part", "key"], "left_semi").select("part", F.xxhash64("part", "key").alias("bucket"), "fp", "kind")
        inside = stage(inside.mapInArrow(_keys_inside(again), "part int, bucket long, key long, fp long, kind byte"), "inside")
        first, more = _dealt(keyed.join(few, ["part", "key"], "left_anti"), ["part", "key"])
        second, deep = _dealt(inside, ["part", "bucket", "key"])
        dealt, more = first.unionByName(second), [*more, *deep, inside]
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(radius), "a long, b long"), [*held, *more]


def _grouped(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, text_hash, fp) of every row; (fp, n, first) of every fingerprint: its rows, and the first row of its
    component as (without an id, doc_id, text_hash); and the number of rows."""
    fps = stage(fingerprints(docs), "fps")
    total = fps.count()
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = stage(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min(row).alias("first")), "nodes")
    found, used = links(nodes.select("fp"), radius)
    roots = components(found)
    drop(*used)
    linked = stage(nodes.join(roots, nodes.fp == roots.node).select("fp", "n", "first", "root"), "linked")
    tops = stage(linked.groupBy("root").agg(F.count("*").alias("held"), F.min("first").alias("least")), "tops")
    several = join_hot(linked.select("fp", "n", "root"), tops, "root", "held", total).select("fp", "n", F.col("least").alias("first"))
    alone = nodes.join(roots, nodes.fp == roots.node, "left_anti")
    return fps, stage(several.unionByName(alone.select("fp", "n", "first")), "named", [nodes, roots, linked, tops]), total


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text; more columns are ignored).

    component_id is the least doc_id among the documents reachable over links of at most `radius` bits. Equal
    fingerprints count as one node; so do all documents without a word, whose fingerprint is zero. Repeated rows stay
    repeated; rows that share a doc_id but not their text are nodes of their own. Rows with a null doc_id get the
    component of their fingerprint (null if it has no other row). An empty table gives an empty result.
    """
    fps, named, total = _grouped(docs, radius)
    found = join_hot(fps, named, "fp", "n", total)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay, with their columns: one of each component, the one with the least doc_id.

    Documents without a word have fingerprint zero and count as copies of one another. Rows without a doc_id come after
    all others, rows that share one are ordered by a hash of their text, and of rows equal in both one stays. The texts
    are not shuffled, unless more rows go than can be broadcast. An empty table gives an empty result.
    """
    fps, named, total = _grouped(docs, radius)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    held = join_hot(fps, named, "fp", "n", total).select("doc_id", "text_hash", (row == F.col("first")).alias("kept"))
    held = stage(held.groupBy("doc_id", "text_hash", "kept").count().where("NOT kept OR count > 1"), "not-kept", [fps, named])
    id_, hash_, d, t = unused(docs.columns, "__id", "__hash", "__d", "__t")
    rows = docs.withColumns({id_: F.col("doc_id").cast("long"), hash_: F.xxhash64(F.col("text").cast("string"))})
    same = F.col(id_).eqNullSafe(F.col(d)) & (F.col(hash_) == F.col(t))

    def keys(condition: str) -> tuple[DataFrame, int]:
        out = held.where(condition).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t))
        n = out.count()
        return F.broadcast(out) if n <= BROADCAST_ROWS else out, n

    (gone, _), (twice, repeats) = keys("NOT kept"), keys("kept")
    kept = rows.join(gone, same, "left_anti")
    if repeats:
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([id_, hash_]))
    return kept.select(docs.columns)

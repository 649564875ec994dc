"""Line dedup by pairwise alignment.

Documents that share a line are aligned with patience diff; common blocks are deleted from the later document. A
document is paired with the first holder of each of its shared lines, however many hold it, so that a line in n
documents gives n - 1 pairs and not n^2. The same goes for each run of neighbouring lines that can be cut as a block,
as the first holders of its lines need not hold the run. A document that very many others are paired with is sent to
several tasks, SALT partners to each. Exact copies (line by line) are one document until the end; the later ones lose
all their lines. Lines are paired by one hash of 64 bits, and deleted only if a second one agrees as well.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import ship, stage, unused

#: A common block is deleted if it has so many lines that are not blank, or so many characters.
MIN_LINES, MIN_CHARS = 3, 40
#: Partners of one document that one task aligns.
SALT = 4096
#: Up to so many documents with more partners are broadcast (24 bytes each); more would need SALT times as many pairs.
BROADCAST_ROWS = 1_000_000


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by the first, whose seconds rise (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[k], piles[k] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Matching blocks (start in a, start in b, length), in order: lines unique to both sides anchor, and what lies
    between two anchors is aligned in the same way."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, l = todo.pop()  # noqa: E741
        while i < j and k < l and a[i] == b[k]:
            matched.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < l and a[j - 1] == b[l - 1]:
            j, l = j - 1, l - 1  # noqa: E741
            matched.append((j, l))
        if i == j or k == l:
            continue
        here, there = Counter(a[i:j]), Counter(b[k:l])
        place = {x: at for at, x in enumerate(b[k:l], k) if there[x] == 1}
        anchors = _rising([(at, place[x]) for at, x in enumerate(a[i:j], i) if here[x] == 1 and x in place])
        if not anchors:
            continue
        matched += anchors
        for (p, q), (r, s) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, l)]):
            if p + 1 < r and q + 1 < s:
                todo.append((p + 1, r, q + 1, s))
    blocks: list[tuple[int, int, int]] = []
    for p, q in sorted(matched):
        if blocks and blocks[-1][0] + blocks[-1][2] == p and blocks[-1][1] + blocks[-1][2] == q:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((p, q, 1))
    return blocks


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for id_, mine, size, check, theirs, other in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "size", "g", "ph", "pg"))):
            cut = []
            for there, at, n in patience(theirs, mine):
                lines = [i for i in range(at, at + n) if size[i] and check[i] == other[there + i - at]]
                if len(lines) >= MIN_LINES or sum(size[i] for i in lines) >= MIN_CHARS:
                    cut += lines
            out.append({"id": id_, "cut": cut})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("id", batch.schema.field("id").type), ("cut", pa.list_(pa.int32()))]))


def _key() -> Column:
    """The doc_id and a hash of the text, in this order. Rows that agree in both are one document; rows that only share
    the doc_id are ordered by the hash; rows without a doc_id come first."""
    return F.struct(F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("t"))


def _runs_of(n: int) -> Column:
    there = lambda i: [F.get("x", i + k) for k in range(n)]
    at = F.sequence(F.lit(0), F.size("x") - n)
    if n < MIN_LINES:
        at = F.filter(at, lambda i: sum((y["size"] for y in there(i)), F.lit(0)) >= MIN_CHARS)
    run = F.transform(at, lambda i: F.xxhash64(*[c for y in there(i) for c in (y["h"], y["at"] - F.get("x", i)["at"])]))
    return F.when(F.size("x") >= n, run).otherwise(F.array().cast("array<long>"))


def runs(own: DataFrame) -> DataFrame:
    """(id, keys): hashes of each line that is not blank, and of each run of up to MIN_LINES such lines, with the blank
    ones between them, that is a block to delete. Every larger block consists of such runs."""
    full = F.filter(F.transform(F.arrays_zip("h", "size"), lambda x, i: F.struct(x["h"].alias("h"), x["size"].alias("size"), i.alias("at"))), lambda x: x["size"] > 0)
    lines = own.select("id", full.alias("x"))
    keys = [F.transform("x", lambda x: x["h"]), *[_runs_of(n) for n in range(2, MIN_LINES + 1)]]
    return lines.select("id", F.array_distinct(F.concat(*keys)).alias("keys"))


def cuts(docs: DataFrame) -> DataFrame:
    """(id, all, cut) of each document that loses lines: all of them, or those at the places in `cut`."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = docs.select(_key().alias("id"), F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")).alias("l"))
    parts = parts.select("id", F.transform("l", lambda x: F.xxhash64(x)).alias("h"), F.transform("l", lambda x: F.xxhash64(F.lit(1), x)).alias("g"), F.transform("l", lambda x: F.length(x)).alias("size"))
    rows = stage(parts.withColumn("copy", F.struct(F.xxhash64("h"), F.xxhash64("g"))), "lines")

    first = stage(rows.groupBy("copy").agg(F.min("id").alias("first"), F.max("id").alias("last")), "first")
    several = first.where("first != last").select("copy", "first")
    copies = rows.join(several, "copy").where("id != first").where(F.exists("size", lambda x: x > 0)).select("id").distinct()
    copies = stage(copies, "copies")
    own = stage(rows.join(first.select(F.col("first").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", "h", "g", "size"), "own", [rows, first])

    # Of a plain explode, size(keys) > 0 would be pushed below, with the arrays' expressions computed for every element.
    lines = runs(own).select("id", F.explode_outer("keys").alias("line")).where("line is not null")
    shared = stage(lines.groupBy("line").agg(F.count("*").alias("df"), F.min("id").alias("holder")).where("df > 1").select("line", "holder"), "shared")
    pairs = lines.join(shared, "line").where("holder != id").select("id", F.col("holder").alias("partner")).distinct()
    pairs = stage(pairs, "pairs", [shared])  # rows of a frequent line are split by adaptive execution

    held = stage(pairs.groupBy("partner").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts")), "held")
    dealt = pairs.join(held.where("salts > 1").hint("broadcast" if held.where("salts > 1").count() <= BROADCAST_ROWS else "merge"), "partner", "left")
    dealt = dealt.select("id", "partner", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))
    side = own.select(F.col("id").alias("partner"), F.col("h").alias("ph"), F.col("g").alias("pg")).join(held, "partner")
    side = side.select("partner", "ph", "pg", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = dealt.join(own, "id").join(side, ["partner", "salt"]).select("id", "h", "size", "g", "ph", "pg")
    made = both.mapInArrow(_align, "id struct<d:long,t:long>, cut array<int>")
    cut = made.where("size(cut) > 0").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut"))
    whole = copies.select("id", F.lit(True).alias("all"), F.lit(None).cast("array<int>").alias("cut"))
    out = whole.unionByName(cut.select("id", F.lit(False).alias("all"), "cut"))
    return stage(out, "cuts", [copies, own, pairs, held])


_SPACE = " \t\n\v\f\r"


def _cut(text: str, whole: str, cut: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone = [], [], []
            for t, all_, places in zip(*(batch.column(c).to_pylist() for c in (text, whole, cut))):
                lines = (t or "").split("\n")
                drop = {i for i, x in enumerate(lines) if x.strip(_SPACE)} if all_ else set(places or ())
                kept.append(None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else t)
                total.append(len(lines))
                gone.append(len(drop))
            own = [c for c in batch.schema.names if c not in (text, whole, cut)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*own, "kept_text", "n_lines", "n_removed"])

    return run


def dedup(docs: DataFrame) -> DataFrame:
    """docs with `kept_text`, `n_lines` and `n_removed`: each text without the lines that an earlier document holds in the same order.

    Lines are cut at \\n and compared without spaces at their ends; blank lines are never removed. Null texts have one
    blank line and stay null. Rows with null or repeated doc_ids: see _key(). Columns of docs with these three names, in
    any case, are replaced; other names are free. An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c.lower() not in ("kept_text", "n_lines", "n_removed")]
    id_, d, t, text, whole, cut = unused(docs.columns, "__id", "__d", "__t", "__text", "__all", "__cut")
    found = cuts(docs).select(F.col("id.d").alias(d), F.col("id.t").alias(t), F.col("all").alias(whole), F.col("cut").alias(cut))
    rows = docs.select(*own, F.col("text").cast("string").alias(text), _key().alias(id_))
    rows = rows.join(found, F.col(f"{id_}.d").eqNullSafe(F.col(d)) & (F.col(f"{id_}.t") == F.col(t)), "left").select(*own, text, whole, cut)
    schema = rows.select(own).schema.add("kept_text", "string").add("n_lines", "long").add("n_removed", "long")
    return rows.mapInArrow(_cut(text, whole, cut), schema)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every row."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("kept_text", F.lit("")), "utf-8"), 256).alias("kept_sha256"))

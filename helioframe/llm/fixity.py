"""Merkle fixity audit of WARC replicas: record digests and ordered offset ranges hashed into trees.

An archive is a folder of record files (each record one gzip member, as is customary for WARC) with an index of where
each record lies. The members of a file are read by offset and hashed as they are stored into a tree: a leaf holds the records of one place, FANOUT neighbours make a parent, up to one root
for each file; the files are leaves of a tree over the archive in the same way, SPREAD at a time. A leaf hashes, in
order, each record's digest, length and gap (the bytes between the end of the record before it and its start); a parent
hashes each child's number, its range relative to the parent's first byte, and its hash. So records that change, go,
come, or lie at another place or in another order change the hashes above them, while a record that is lost leaves the
leaves after it as they are. Two replicas are compared from the roots down, and only children of nodes that differ are
looked at.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.common import drop, new_folder, ship, stage

FANOUT, FILE_SPAN = 16, 512
#: Levels 0 to 3 lie inside a file (FILE_SPAN <= FANOUT ** 3); the others combine files, SPREAD at a time.
FILE_LEVELS, SPREAD = 3, 256
#: Records of one id beyond which they are dealt over several files, bytes of one writing or reading task, most tasks.
MANY, TASK_BYTES, TASKS = 8192, 64 << 20, 20_000
_NODE = "level int, file long, node long, page_id long, first long, last long, gap long, hash string"


class Archive(NamedTuple):
    """A folder of record files, and (file, name, slot, page_id, offset, length, at, size) of every record: its place as
    it is stored, and in the file without compression."""

    folder: str
    index: DataFrame


def warc_record(url: Column, body: Column) -> Column:
    """The bytes of one response record, without fields that differ between writings."""
    body = F.encode(F.coalesce(body, F.lit("")), "utf-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "utf-8"), body, F.encode(F.lit("\r\n\r\n"), "utf-8"))


def _tasks(spark, total: int) -> int:
    return min(TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1))


def _root(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))


def _batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_INDEXED = pa.schema([("file", pa.int64()), ("name", pa.string()), ("slot", pa.int32()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("at", pa.int64()), ("size", pa.int64())])
_INDEX = "file long, name string, slot int, page_id long, offset long, length long, at long, size long"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (the last column) as gzip members, the same in every writing, with the length that they had."""
    for batch in batches:
        records = batch.column(batch.num_columns - 1)
        made = [gzip.compress(r.as_py(), 6, mtime=0) for r in records]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary()), pa.array([len(r.as_py()) for r in records], pa.int64())], names=[*batch.schema.names, "size"])


def _put(folder: str, rows: Iterable[tuple[int, int, int | None, bytes, int]]) -> Iterator[tuple]:
    """Writes (file, slot, page_id, member, size), in order of files, to one file each; the index. A file's name is that of its
    try, so that a task that is run again meets no file of the try before; only files in the index count."""
    fs, root = _root(folder)
    fs.create_dir(root, recursive=True)
    out, now, name, offset, at = None, None, "", 0, 0
    for file, slot, page, member, size in rows:
        if file != now:
            if out is not None:
                out.close()
            now, name, offset, at = file, f"{file:+d}-{TaskContext.get().taskAttemptId()}.warc.gz", 0, 0
            out = fs.open_output_stream(f"{root}/{name}", compression=None)  # the members are packed already
        out.write(member)
        yield file, name, slot, page, offset, len(member), at, size
        offset, at = offset + len(member), at + size
    if out is not None:
        out.close()


def write(pages: DataFrame, folder: str | None = None) -> Archive:
    """The archive of pages (page_id, url, html): files of FILE_SPAN consecutive ids, in order of id and digest; `slot` is
    an id's place among the leaves of its file.

    Null urls and bodies are empty; repeated rows are written as often as they occur. Pages without an id lie in files
    with negative numbers, by a hash of the record; so do those of an id with over MANY rows, so that no task writes all
    of them, and copies of one record over MANY times by their place in the table. More columns are ignored; an empty table gives an empty archive.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "warc")
    total, n = pages.agg(F.sum(F.octet_length(F.col("html").cast("string"))), F.count("*")).first()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), warc_record(F.col("url").cast("string"), F.col("html").cast("string")).alias("record"))
    rows = rows.withColumns({"content": F.xxhash64("record"), "place": F.monotonically_increasing_id()})
    limit = max(MANY, n // 100_000)  # fewer than 100,000 ids have more rows, so that these are broadcast, and so are copies
    hot = rows.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("many")).where((F.col("many") > limit) | F.col("id").isNull())
    same = rows.groupBy(F.col("page_id").alias("of"), F.col("content").alias("copy")).count().where(F.col("count") > limit).drop("count")
    rows = rows.join(F.broadcast(hot), F.col("page_id").eqNullSafe(F.col("id")), "left")
    rows = rows.join(F.broadcast(same), F.col("page_id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("copy")), "left")
    apart, spread = F.col("many").isNotNull(), F.when(F.col("copy").isNull(), F.col("content")).otherwise(F.col("place"))
    volume = -1 - F.pmod(F.xxhash64("page_id", F.pmod(spread, F.ceil(F.col("many") / MANY))), F.lit(1 << 40))
    file = F.when(apart, volume).otherwise(F.floor(F.col("page_id") / FILE_SPAN)).alias("file")
    rows = rows.select(file, F.pmod(F.when(apart, spread).otherwise(F.col("page_id")), F.lit(FILE_SPAN)).cast("int").alias("slot"), "page_id", "record")
    rows = rows.mapInArrow(_packed, "file long, slot int, page_id long, record binary, size long")
    dealt = rows.repartition(_tasks(spark, total or 0), "file").sortWithinPartitions("file", "slot", "page_id", F.sha2("record", 256))
    index = dealt.mapInArrow(lambda batches: _batched(_put(folder, _rows(batches)), _INDEXED), _INDEX)
    return Archive(folder, stage(index, "index"))


def _dealt(archive: Archive) -> DataFrame:
    """The index with all rows of a file, in order of their leaves, in one task; a file has FILE_SPAN ids, or some MANY records."""
    spark = archive.index.sparkSession
    total = archive.index.agg(F.sum("length")).first()[0] or 0
    return archive.index.select(*_INDEXED.names).repartition(_tasks(spark, total), "file").sortWithinPartitions("file", "slot", "page_id", "offset")


def read(archive: Archive) -> Iterator:
    """What reads the members of index rows: (file, slot, page_id, offset, member)."""
    folder = archive.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        fs, root = _root(folder)
        now, held = None, None
        for file, name, slot, page, offset, length, *_ in _rows(batches):
            if name != now:
                if held is not None:
                    held.close()
                now, held = name, fs.open_input_file(f"{root}/{name}")
            held.seek(offset)
            yield file, slot, page, offset, held.read(length)
        if held is not None:
            held.close()

    return run


def _file_tree(records: Iterable[tuple[int, int, int | None, int, bytes]]) -> Iterator[tuple]:
    """Rows of _NODE for records (file, slot, page_id, offset, bytes) in order of files and leaves: level -1 is a record,
    0 a leaf, FILE_LEVELS a file's root. Only the open nodes are held, one for each level."""
    opened: list[list | None] = [None] * (FILE_LEVELS + 1)  # number, first, last, hash so far
    now = end = None

    def close(level: int) -> Iterator[tuple]:
        if opened[level] is None:
            return
        for below in range(level):
            yield from close(below)
        number, first, last, made = opened[level]
        opened[level] = None
        digest = made.hexdigest()
        yield level, now, number, None, first, last, None, digest
        if level < FILE_LEVELS:
            up = opened[level + 1]
            up[2] = max(up[2], last)
            up[3].update(f"{number}:{first - up[1]}:{last - up[1]}:{digest}|".encode())

    for file, slot, page, offset, record in records:
        if file != now:
            yield from close(FILE_LEVELS)
            now, end = file, 0
        for level in range(FILE_LEVELS, -1, -1):
            number = slot // FANOUT**level if level < FILE_LEVELS else 0
            if opened[level] is not None and opened[level][0] != number:
                yield from close(level)
            if opened[level] is None:
                opened[level] = [number, offset, offset, hashlib.sha256()]
        digest = hashlib.sha256(record).hexdigest()
        gap, end = offset - end, offset + len(record)
        yield -1, file, slot, page, offset, end, gap, digest
        leaf = opened[0]
        leaf[2] = max(leaf[2], end)
        leaf[3].update(f"{gap}:{len(record)}:{digest}|".encode())
    yield from close(FILE_LEVELS)


_NODES = pa.schema([("level", pa.int32()), ("file", pa.int64()), ("node", pa.int64()), ("page_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("gap", pa.int64()), ("hash", pa.string())])


def tree(archive: Archive) -> tuple[DataFrame, DataFrame]:
    """All nodes of an archive, as read from its files (see _file_tree), and (level, file, node, hash) of the levels above
    the files, where `file` counts groups of files and node is 0."""
    ship(archive.index.sparkSession)
    get = read(archive)
    nodes = stage(_dealt(archive).mapInArrow(lambda batches: _batched(_file_tree(get(batches)), _NODES), _NODE), "nodes")
    at = nodes.where(F.col("level") == FILE_LEVELS).select("level", "file", "node", "hash", (F.col("last") - F.col("first")).alias("size"))
    return nodes, at


def _above(at: DataFrame, levels: int) -> list[DataFrame]:
    """The levels over the files' roots: a parent hashes each child's number, its range among its siblings, and its hash."""
    out = []
    for level in range(FILE_LEVELS + 1, FILE_LEVELS + 1 + levels):
        children = F.array_sort(F.collect_list(F.struct("file", "size", "hash")))  # SPREAD at most
        before = lambda x, i: F.aggregate(F.slice("c", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["size"])
        line = F.concat_ws("|", F.transform("c", lambda x, i: F.concat_ws(":", x["file"], before(x, i), before(x, i) + x["size"], x["hash"])))
        up = at.groupBy(F.floor(F.col("file") / SPREAD).alias("up")).agg(children.alias("c"), F.sum("size").alias("all"))
        at = stage(up.select(F.lit(level).alias("level"), F.col("up").alias("file"), F.lit(0).cast("long").alias("node"), F.sha2(line, 256).alias("hash"), F.col("all").alias("size")), f"level{level}")
        out.append(at)
    return out


def differing_leaves(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """(file, node) of the leaves that differ between two trees, found by descending from the roots; and what was staged for it."""
    ends = left[1].unionByName(right[1]).agg(F.min("file"), F.max("file")).first()
    levels, most = 1, max(abs(x or 0) for x in ends)
    while SPREAD**levels <= most:
        levels += 1
    up_a, up_b = _above(left[1], levels), _above(right[1], levels)
    branch = None
    for level in range(FILE_LEVELS + levels, -1, -1):
        a, b = ((up[level - FILE_LEVELS - 1] if level > FILE_LEVELS else own[0].where(F.col("level") == level)).select("file", "node", "hash") for up, own in ((up_a, left), (up_b, right)))
        both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)))
        if branch is not None:
            of = F.floor(F.col("file") / SPREAD) if level >= FILE_LEVELS else F.col("file")
            parent = F.lit(0).cast("long") if level >= FILE_LEVELS - 1 else F.floor(F.col("node") / FANOUT)
            both = both.join(branch.select(F.col("file").alias("of"), F.col("node").alias("parent")), (of == F.col("of")) & (parent == F.col("parent")), "left_semi")
        hashes = [F.max(F.when(F.col("side") == s, F.col("hash"))) for s in (1, 2)]
        branch = both.groupBy("file", "node").agg(*[h.alias(f"h{i}") for i, h in enumerate(hashes)]).where("NOT h0 <=> h1").select("file", "node")
    return stage(branch, "branch"), [*up_a, *up_b]


def audit(ours: Archive, theirs: Archive) -> DataFrame:
    """(page_id, state, file, offset, length) of every record that the replicas do not share, each as often as it occurs.

    state is "corrupt" for a record of ours whose id has another record in the replica, "missing" for one whose id has
    none, "extra" for a record whose id only the replica has, and "moved" for one that the replica has too, but with
    other bytes before it or in another order; place and length are those in the archive that has the record, ours
    first. Equal archives, and empty ones, give no row.
    """
    left, right = tree(ours), tree(theirs)
    leaves, used = differing_leaves(left, right)
    leaf = leaves.withColumnRenamed("node", "slot")

    def records(nodes: DataFrame, side: int) -> DataFrame:
        own = nodes.where("level = -1").select("file", F.col("node").alias("slot"), "page_id", F.col("first").alias("offset"), (F.col("last") - F.col("first")).alias("length"), "gap", "hash")
        return own.join(leaf, ["file", "slot"], "left_semi").withColumn("side", F.lit(side))

    both = records(left[0], 1).unionByName(records(right[0], 2))
    # Of records that are equal in both, so many on either side as the other has are sound.
    same = both.groupBy("file", "slot", "page_id", "length", "gap", "hash").agg(F.collect_list(F.when(F.col("side") == 1, F.col("offset"))).alias("a"), F.collect_list(F.when(F.col("side") == 2, F.col("offset"))).alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    rest = lambda side: F.transform(F.slice(F.array_sort(side), n + 1, F.greatest(F.lit(0), F.size(side) - n)), lambda x: F.struct(F.lit(1 if side == "a" else 2).alias("side"), x.alias("offset")))
    left_over = same.select("file", "slot", "page_id", "length", "hash", F.explode(F.concat(rest("a"), rest("b"))).alias("x")).select("file", "slot", "page_id", "length", "hash", "x.side", "x.offset")
    left_over = stage(left_over, "left-over")
    of_id, of_record = Window.partitionBy("file", "slot", "page_id"), Window.partitionBy("file", "slot", "page_id", "hash")
    count = lambda side: F.count_if(F.col("side") == side).over(of_record)
    nth = F.row_number().over(Window.partitionBy("file", "slot", "page_id", "hash", "side").orderBy("offset"))
    out = left_over.withColumn("twin", nth <= F.least(count(1), count(2)))  # so many lie elsewhere; the others are gone or new
    alone = F.when(~F.col("twin"), F.col("side"))
    out = out.withColumns({"a": F.min(alone).over(of_id), "b": F.max(alone).over(of_id)})
    state = F.when(F.col("twin"), "moved").when(F.col("b") == 1, "missing").when(F.col("a") == 2, "extra").otherwise("corrupt")
    # A record that was changed or moved is told once, by its place in ours.
    out = out.select("page_id", state.alias("state"), "file", "offset", "length", "side").where("side = 1 OR state = 'extra'").drop("side")
    return stage(out, "damage", [left_over, leaves, left[0], right[0], *used])


def damaged(archive: Archive, folder: str | None = None) -> Archive:
    """A replica of an archive with faults planted by a hash of the id: about one record in 256 has a byte of its body
    changed, one is cut in half, and one is lost."""
    spark = archive.index.sparkSession
    ship(spark)
    folder, get = folder or new_folder(spark, "replica"), read(archive)

    def faults(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for file, slot, page, _, member in get(batches):
            record = gzip.decompress(member)
            sign = hashlib.md5(str("" if page is None else page).encode()).hexdigest()[:2]
            body = record.index(b"\r\n\r\n") + 4
            if sign == "00":
                record = record[:body] + b"~" + record[body + 1 :] if record[body : body + 1] != b"~" else record[:body] + b"!" + record[body + 1 :]
            elif sign == "01":
                record = record[: len(record) // 2]
            if sign != "02":
                yield file, slot, page, gzip.compress(record, 6, mtime=0) if sign in ("00", "01") else member, len(record)

    index = _dealt(archive).mapInArrow(lambda batches: _batched(_put(folder, faults(batches)), _INDEXED), _INDEX)
    return Archive(folder, stage(index, "replica-index"))


def digest(pages: DataFrame) -> DataFrame:
    """(page_id, state, offset, length) of the records that a damaged replica of the archive of pages does not share with
    it; places are those in the uncompressed file."""
    ours = write(pages)
    theirs = damaged(ours)
    found = audit(ours, theirs)
    drop(theirs.index)
    places = ours.index.select("file", "offset", "at", "size")
    return found.join(places, ["file", "offset"]).select("page_id", "state", F.col("at").alias("offset"), F.col("size").alias("length"))


ORACLE = r"""
WITH r AS (SELECT page_id, left(md5(CAST(page_id AS VARCHAR)), 2) AS sign, html, CAST(floor(page_id / 512.0) AS BIGINT) AS file,
  CAST(octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(octet_length(encode(html)) AS VARCHAR)))
    + 8 + octet_length(encode(html)) AS BIGINT) AS length FROM pages),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT page_id, CASE sign WHEN '02' THEN 'missing' ELSE 'corrupt' END AS state, "offset", length FROM o WHERE sign IN ('00', '01', '02')
"""

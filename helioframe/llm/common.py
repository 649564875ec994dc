"""Helpers that the training-data operators share: text columns, staged tables, joins on hot keys, connected components."""

from __future__ import annotations

import atexit
import uuid
import weakref
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.plans.workers import ship  # noqa: F401  (operators take it from here)

#: What separates words everywhere in this subpackage: space, tab, \n, \v, \f, \r.
SPACES = r"[\x20\x09-\x0D]+"
#: Keys with over total / HOT rows, fewer than HOT of them at any size, are joined by broadcast; none with so few rows.
HOT, HOT_ROWS = 100_000, 1000

#: Folders of staged tables that may still be read.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_helioframe"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/helioframe/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(drop_folder, spark, path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already; the folder is then the cluster's to clean
        pass


def stage(df: DataFrame, name: str, done: Iterable[DataFrame] = ()) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage is cut, and the loss of an executor costs nothing.

    `done` are staged tables that nothing reads after this one; their folders are removed.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    drop(*done)
    return out


def drop(*staged: DataFrame) -> None:
    """Remove the folders of staged tables that nothing reads any more."""
    for df in staged:
        drop_folder(df.sparkSession, _folders.pop(df))


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart, in any case, from those taken."""
    held, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def apart(df: DataFrame, prefix: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns that start with the prefix under other names, and what selects df's columns by their own names again."""
    names = dict(zip(df.columns, (x if not x.lower().startswith(prefix) else f"own{i}{x}" for i, x in enumerate(df.columns))))
    return df.toDF(*names.values()), lambda out: out.select(*[F.col(f"`{b}`").alias(a) for a, b in names.items()])


def join_hot(left: DataFrame, right: DataFrame, on: str | list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right on columns of both; right has one row for each key, and in n how often left has it.

    The keys that have over total / HOT of left's rows are fewer than HOT, however large the tables are. They are
    broadcast, so that no task gets all rows of one; the other keys are shuffled. n is dropped.
    """
    limit = max(HOT_ROWS, total // HOT)
    hot, rest = right.where(F.col(n) > limit).drop(n), right.where(F.col(n) <= limit).drop(n)
    key = F.broadcast(hot.select(on))
    return left.join(F.broadcast(hot), on).unionByName(left.join(key, on, "left_anti").join(rest, on, how))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words, without building them: starts of runs of other characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def settled(df: DataFrame) -> DataFrame:
    """df, with conditions on its columns evaluated after them, whoever states them.

    Pushed below a projection, a condition on a computed array has the array's expression in place of its name, also
    inside lambdas, where it would be computed again for every element. A condition on a row number stays above it, and
    takes later ones along.
    """
    (late,) = unused(df.columns, "__late")
    return df.withColumn(late, F.monotonically_increasing_id()).where(F.col(late) >= 0).drop(late)


def where_late(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), evaluated after df's own columns."""
    return settled(df).where(condition)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the edges (a, b): each node with the least node that it reaches, as (node, root).

    Minimum labels spread along the edges, then every label is replaced by its own label (pointer jumping),
    so that a path of n nodes takes about log n rounds; beyond `rounds` it raises. Each round is written to the shared
    folder, and the one before is removed; the driver sees counts only. Hubs with very many links, and roots of very
    large components, are joined by broadcast (join_hot), so that no task gets all of their rows.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    total = both.count()
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count("*").alias("n")).select("node", F.least("node", "least").alias("root"), "n"), "labels")
    nodes = labels.count()
    for _ in range(rounds):
        near = join_hot(both, labels.withColumnRenamed("node", "b"), "b", "n", total).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        spread = stage(labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"), "n"), "spread", [labels])
        tops = spread.groupBy("root").agg(F.count("*").alias("held")).join(spread.select(F.col("node").alias("root"), F.col("root").alias("top")), "root")
        tops = stage(tops, "tops")
        moved = stage(join_hot(spread, tops, "root", "held", nodes).select("node", F.least("root", "top").alias("root"), "was", "n"), "labels", [spread, tops])
        labels = moved.drop("was")
        _folders[labels] = _folders.pop(moved)
        if moved.where("root != was").isEmpty():
            drop(both)
            out = labels.select("node", "root")
            _folders[out] = _folders.pop(labels)
            return out
    raise RuntimeError(f"components did not settle within {rounds} rounds")

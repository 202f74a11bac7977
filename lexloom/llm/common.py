"""What several of the operators share: checkpoints, ASCII text rules and distributed ranks."""

from __future__ import annotations

import functools
import sys
import tempfile
import types

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of every contract here: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Send a module's functions to the executors as code, so that these need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_cache() -> dict:
    """A dict that lives as long as a Python worker, for models that are slow to load."""
    return sys.modules.setdefault("_lexloom_worker", types.ModuleType("_lexloom_worker")).__dict__


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; without one, a temporary folder of its own, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    folder = tempfile.mkdtemp(prefix="lexloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(c, UPPER, UPPER.lower())


def text_of(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def same(a: list[Column], b: list[Column]) -> Column:
    return functools.reduce(lambda x, y: x & y, (p.eqNullSafe(q) for p, q in zip(a, b)))


def distributed_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column], out: str, total: str | None = None) -> DataFrame:
    """1-based rank within `group` by (`bucket`, `order`) without one task seeing a whole group.

    `bucket` must be monotone in the wanted order and cut every group into
    pieces of a bounded size.  Rows are ranked inside their (group, bucket)
    piece; the pieces' counts, a small table, are summed cumulatively per group
    and added.  `total` names a column for the group's size.
    """
    inside = df.withColumn("_r", F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)))
    counts = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    running = within.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    if total:
        counts = counts.withColumn("_total", F.sum("_n").over(within))
    keys = [*group, bucket]
    counts = counts.drop("_n").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_before", *(["_total"] if total else []))
    joined = inside.join(counts, same([F.col(k) for k in keys], [F.col(f"_k{i}") for i in range(len(keys))]))
    joined = joined.withColumn(out, F.col("_r") + F.col("_before"))
    if total:
        joined = joined.withColumn(total, F.col("_total"))
    return joined.drop("_r", "_before", "_total", *(f"_k{i}" for i in range(len(keys))))


def union_find(n: int):
    """find and join over 0..n-1, smallest member as root."""
    parent = list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def join(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    return find, join


def apart(c: str | Column) -> Column:
    """A join key that no earlier shuffle was dealt by.

    Spark then deals both sides of the join out anew, which lets it split what
    one hot key brings to it; with a side that an aggregate left in place it
    could not.
    """
    return F.bitwise_not(F.col(c) if isinstance(c, str) else c)


def components(nodes: DataFrame, edges: DataFrame, node: str = "doc_id", out: str = "label") -> DataFrame:
    """Smallest reachable node id of every node; edges(a, b) are undirected.

    Every round points each node at its least neighbour, follows these pointers
    one step further, and contracts the edges to what they point at, so that
    the graph shrinks geometrically until no edge is left.  Labels and edges
    stay in the cluster; the driver sees one emptiness test a round, and each
    round is checkpointed.  A hot node's edges meet one row of pointers, so a
    skewed join splits them, and minima are combined before the shuffle.
    """
    left = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        least = checkpoint(least)
        step = least.select(F.col("a").alias("q"), F.col("p").alias("r"))
        point = checkpoint(least.join(step, apart("p") == apart("q")).select(F.col("a").alias("n"), F.col("r").alias("p")))
        other = point.select(F.col("n").alias("o"), F.col("p").alias("s"))
        ends = left.join(point, apart("a") == apart("n")).select("b", F.col("p").alias("a"))
        moved = ends.join(other, apart("b") == apart("o")).select("a", F.col("s").alias("b"))
        kept = point.join(other, apart("p") == apart("o")).select(F.col("p").alias("a"), F.col("s").alias("b"))
        pairs = moved.unionByName(kept).where("a <> b")
        left = checkpoint(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if labels is None:
            labels = point.select("n", F.col("p").alias("l"))
        else:
            labels = checkpoint(labels.join(other, apart("l") == apart("o"), "left").select("n", F.coalesce("s", "l").alias("l")))
    if labels is None:
        return nodes.withColumn(out, F.col(node))
    return nodes.join(labels, apart(nodes[node]) == apart(labels.n), "left").select(nodes["*"], F.coalesce("l", nodes[node]).alias(out))


by_value(__name__)

"""What the operators share: the cluster's shared folder, prefix sums, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of edges that one executor task may finish by union-find.
LAST_EDGES = 50_000
#: Bytes of a row group, which a writing task holds in memory, and of an Arrow batch of texts.
ROW_GROUP, BATCH = 16 << 20, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where all runs in one process, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="kinframe-")
        atexit.register(shutil.rmtree, own, True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of written() that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def in_batches(df: DataFrame) -> DataFrame:
    """df, whose rows will go to Python in Arrow batches of some BATCH bytes, however long texts are (unless the session asks for another size)."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(64 << 20), "64MB", "67108864b"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: workers live on and share a machine with the next stages."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have, in any casing."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column], name: str = "prefix") -> DataFrame:
    """Adds for each name in sums the sum of its column over all rows that come before in the given order.

    Rows are range-partitioned once and written; each partition's totals (one row a partition) give the
    partitions' offsets, and a window inside each partition does the rest. No task sees more than a partition.
    ``order`` should be unique; rows that tie get places in any order. ``_total_<name>`` holds the whole sum.
    """
    ranged = df.repartitionByRange(parts(df), *order).withColumn("_part", F.spark_partition_id())
    rows, _ = written(ranged.withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)).cast("long") for k, v in sums.items()}), name)
    totals = rows.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums))
    before, everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = totals.select(
        "_part",
        *(F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums),
        *(F.sum(f"_s_{k}").over(everything).alias(f"_total_{k}") for k in sums),
    )  # one row a partition
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_i_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums})
    out = out.join(F.broadcast(offsets), "_part")
    keep = [c for c in df.columns if c not in sums]
    return out.select(*keep, *((F.col(f"_o_{k}") + F.col(f"_i_{k}")).alias(k) for k in sums), *(f"_total_{k}" for k in sums))


def _finish(batches):
    """Union-find over at most LAST_EDGES edges."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(p, p)
        return x

    for b in batches:
        for a, c in zip(b["a"].tolist(), b["b"].tolist()):
            a, c = find(a), find(c)
            if a != c:
                root[max(a, c)] = min(a, c)
    nodes = list(root)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "to": pd.Series([find(x) for x in nodes], dtype="int64")})
    root.clear()
    release()


def components(edges: DataFrame, last_edges: int = LAST_EDGES, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given by long columns a and b; component = smallest node.

    Each round every node moves to that neighbour (or itself) which a hash of the round ranks lowest, and the
    edges are contracted; the expected number of nodes falls geometrically, whatever the graph's shape. Rounds
    are written to the shared folder. Once no more than ``last_edges`` distinct edges are left (a fixed bound),
    one executor task ends the work. A self-loop only makes its node known.
    """
    spark = edges.sparkSession
    nodes, at_nodes = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    left, path = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps, k = [], 0
    while (n := left.count()) > last_edges and k < rounds:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a"))["n"].alias("to"))
        maps.append(written(best, "step"))
        step = maps[-1][0]
        moved = left.join(step.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(step.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        after, new = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        remove(spark, path)
        left, path, k = after, new, k + 1
    if n:
        if n > last_edges:
            raise RuntimeError(f"components: {n} edges left after {rounds} rounds")
        maps.append(written(left.coalesce(1).mapInPandas(_finish, "node long, to long"), "step"))
    at = nodes.withColumn("at", F.col("node"))
    for m, _ in maps:
        at = at.join(m.withColumnRenamed("node", "at"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    at, at_path = written(at, "at")
    out, _ = written(at.join(at.groupBy("at").agg(F.min("node").alias("component")), "at").select("node", "component"), "components")
    remove(spark, path, at_nodes, at_path, *(p for _, p in maps))
    return out


def semi(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", most: int = 1_000_000) -> DataFrame:
    """df's rows whose key is (left_semi) or isn't (left_anti) in ids; ids go by broadcast only if they number ``most`` at the most."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, key, how)

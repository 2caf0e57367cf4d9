"""Shared helpers: table access, intermediate tables in the shared folder, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import deploy

BATCH = deploy.BATCH


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors, and bound by bytes the batches that go to Python workers."""
    deploy.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, whatever file system that path names."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder; a local one only for a local master (tests)."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if not getattr(context, "_lectern_dir", None):
        context._lectern_dir = "file://" + tempfile.mkdtemp(prefix="lectern-shared-")
    return context._lectern_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path).getParent()
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables written by :func:`save` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for frame in frames:
        path = jvm.org.apache.hadoop.fs.Path(frame._lectern_path).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark, name)
    df.write.options(**(options or {})).parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let the driver's cleaner drop shuffle files of steps that are over, instead of at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def local_forest(batches: Iterator) -> Iterator:
    """Per partition, replace edges (a, b) by a star forest with the same components."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    for i in range(0, len(nodes), 65536):
        part = nodes[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the component's smallest id.

    Alternating large-star and small-star steps (Kiveris et al. 2014) over aggregates and joins only, so
    that a hub's edges are combined before the shuffle and a skewed join can be split. Each round is written
    to the shared folder. Nodes without edges do not appear.
    """
    spark = edges.sparkSession
    now = save(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).mapInArrow(local_forest, "a long, b long"), "edges")
    before = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest).distinct()
        then = save(small, "edges")
        drop(spark, now)
        now = then
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


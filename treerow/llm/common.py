"""Helpers shared by the operators: scratch tables in the cluster's shared folder, and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a session in one process may use its own folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    Each table is an ordinary Parquet write, so a later stage that loses an executor rereads files
    instead of recomputing. ``drop`` removes a table that no lazy plan reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, free: bool = True) -> DataFrame:
        """Write df, let Spark drop the shuffle files behind it (unless they are small), and return the table."""
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        schema = df.schema
        del df
        if free:
            self.spark.sparkContext._jvm.System.gc()  # the context cleaner frees shuffles of dead plans
        return self.spark.read.schema(schema).parquet(path)

    def _files(self):
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        path, files = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path, self._files()[1]
        for name in names:
            files.delete(path(self.path(name)), True)

    def drop_all_but(self, *names: str) -> None:
        root, files = self._files()
        self.drop(*({f.getPath().getName() for f in files.listStatus(root)} - set(names)))


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows of an Arrow batch, so that very long texts fit a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v): root is the smallest node reachable.

    Large-star and small-star rounds: each node hands its neighbours to its smallest neighbour until no
    edge changes. Every round is an aggregate with partial sums and a join on the node, both of which
    Spark can split, and is written to the shared folder. An empty input gives an empty result.
    """
    now = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), f"{name}0")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for i in range(1, rounds + 1):
        if not seen[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join deals both sides anew and can split a node of very many edges
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}{i}_least", free=False)
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every edge of large points down (u > v)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.write(small, f"{name}{i}", free=i % 4 == 0)
        scratch.drop(f"{name}{i - 1}", f"{name}{i}_least")
        was, seen = seen, mark(now)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def append_columns(docs: DataFrame, text_col: str, make, fields: list, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with columns that ``make(list of bytes or None) -> list of arrays`` finds in each text.

    ``make`` is called once per Arrow batch, in a map without a shuffle. Appended names start with
    ``__`` so that they can't clash with columns of the input. Texts arrive as UTF-8 bytes.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    keep = docs.columns if keep is None else keep
    inside = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("binary").alias("__bytes"))
    schema = T.StructType([*docs.select(*(f"`{c}`" for c in keep)).schema.fields, *fields])
    names = [*keep, *(f.name for f in fields)]

    def run(batches):
        for b in batches:
            made = make(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=names)

    return inside.mapInArrow(run, schema)

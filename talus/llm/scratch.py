"""Lineage cuts in the shared folder, and small distributed helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows and bytes a batch that workers get, where the session has not set its own: texts may be long.
BATCH = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it is unset a
    temporary folder is set once, on one machine only (tests): a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="talus-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Intermediate tables of one query. ``save`` writes a table to the shared
    folder and reads it back, so a lost executor costs no recomputation of what
    lies before; ``drop`` deletes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        for name, usual, small in BATCH:
            if spark.conf.get(name, usual) == usual:
                spark.conf.set(name, small)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._talus_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._talus_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to."""
        gc.collect()
        self.spark._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(scratch: Scratch, df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Adds the 0-based global rank by ``order`` (total order expected) without
    a single-task sort: rows are dealt by range and saved, counted per partition,
    and only those counts (one number each) meet on the driver."""
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    seen, start = 0, []
    for p in range(max(counts, default=0) + 1):
        start.append(seen)
        seen += counts.get(p, 0)
    offset = F.element_at(F.array(*map(F.lit, start)), F.col("_part") + 1).cast("long")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn(name, offset + inner).drop("_part")


def join_hot(facts: DataFrame, dims: DataFrame, key: str, spread: Column, salts: int = 64) -> DataFrame:
    """Inner join of ``facts`` with ``dims`` (one row a key) where a key may hold
    a third of the facts: facts are dealt by (key, salt), the salt from ``spread``, and
    a row of ``dims`` goes only to the salts in which its key occurs. ``facts``
    is read twice, so it should be saved or cheap."""
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    spots = salted.select(key, "_salt").distinct().join(dims, key)
    return salted.join(spots, [key, "_salt"]).drop("_salt")


def one_text(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with one row a doc_id: of several texts the least one stands. Only a
    table that repeats a doc_id is grouped and written."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs
    return scratch.save(docs.groupBy("doc_id").agg(F.min("text").alias("text")))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), where the
    component is its smallest id. Alternates large-star and small-star steps
    until no edge changes; every step is a partial aggregation by node and a join that AQE
    may split at hubs, and its edges go to the shared folder."""
    pick = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    now = scratch.save(edges.where("a <> b").select(*pick(F.col("a"), F.col("b"))).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(*pick(F.col("b"), F.col("m")))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(*pick(F.col("b"), F.col("m"))).where("a <> b")
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.save(small)
        mark = new.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        scratch.drop(now)
        now = new
        if (mark["n"], mark["x"]) == state:
            break
        state = (mark["n"], mark["x"])
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)

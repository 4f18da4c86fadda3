"""Merkle manifest of a dataset: one hash tree of fan 16 a source, and one over the sources.

A row's leaf is the digest of its columns, each with its length in front. Within a source leaves
ascend by doc_id and get a rank; 4,096 ranks, aligned, are a block, whose three levels need no
other block. A block goes to an executor as one Arrow table, where DuckDB (one thread, no disk)
runs the level queries: an ordered string_agg of each run of 16, then sha256. Spark ranks the rows,
takes the blocks' roots as the next layer's nodes, until one is left a source, does the same over the
sources, and joins the way up (what stands before and after a node, level by level) to the blocks.
Only digests move, never texts; a block's size is fixed, so a hot source is many blocks.

Defined cases: any column may be null ('-'), an empty text has length 0; null is a source, which
comes first; null doc_ids come first in their source and are not tampered with; rows that
share a doc_id are leaves of their own, ordered by digest; equal rows are equal leaves; very long texts are
hashed whole and do not move; a source of one row has its leaf as subroot; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.scratch import Scratch, ranked

FAN = 16
BLOCK = FAN**3

#: What precedes and follows a node among the children of its parent, as hex text; from the node upwards.
PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """``-`` if null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(grp, doc_id, leaf, seen): the leaf, and the leaf as it is seen afterwards, where ``tampered``
    rows have their A-Z lower-cased. A group's name sorts as its source does, null first."""
    seen = F.col("leaf") if tampered is None else F.when(tampered, digest(lowered(F.col("text")))).otherwise(F.col("leaf"))
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.withColumn("leaf", digest(F.col("text"))).select(group.alias("grp"), "doc_id", "leaf", seen.alias("seen"))


def every_fifth() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def numbered(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Adds ``idx``, the 0-based rank in the group by (doc_id, leaf). Rows are dealt by range; a
    group that began in an earlier range goes on there, and only a range's first group can: one number a range
    meets the driver."""
    order = ("doc_id", "leaf")
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(scratch.save(rows).repartitionByRange(parts, "grp", *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part", "grp").agg(F.count("*").alias("n"))
    ends = sizes.groupBy("_part").agg(F.min(F.struct("grp", "n")).alias("first"), F.max(F.struct("grp", "n")).alias("last")).collect()
    starts, name, held = [0] * (max((r["_part"] for r in ends), default=0) + 1), None, 0
    for r in sorted(ends, key=lambda r: r["_part"]):
        start = starts[r["_part"]] = held if r["first"]["grp"] == name else 0
        held = r["last"]["n"] + (start if r["first"]["grp"] == r["last"]["grp"] else 0)
        name = r["last"]["grp"]
    ranges = Window.partitionBy("_part")
    within = F.row_number().over(Window.partitionBy("_part", "grp").orderBy(*order)) - 1
    start = F.when(F.col("grp") == F.min("grp").over(ranges), F.element_at(F.array(*map(F.lit, starts)), F.col("_part") + 1)).otherwise(0)
    return scratch.save(dealt.withColumn("idx", (within + start).cast("long")).drop("_part"))


class Engine:
    """The level queries over one block of nodes (idx, h)."""

    def __init__(self, block: pa.Table, full: int):
        import duckdb

        self.sql = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "256MB", "temp_directory": ""})
        self.sql.register("block", block)
        self.sql.execute("CREATE TABLE level AS SELECT idx, h FROM block")
        ((n, first),) = self.sql.execute("SELECT count(*), min(idx) FROM level").fetchall()
        self.levels = 0
        # A block that is not its group's only one climbs as far as a full block does.
        while FAN**self.levels < (full if first >= full else n):
            self.levels += 1

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.sql.close()

    def climb(self) -> None:
        self.sql.execute(f"CREATE OR REPLACE TABLE level AS SELECT idx // {FAN} AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM level GROUP BY 1")

    def root(self) -> str:
        for _ in range(self.levels):
            self.climb()
        return self.sql.execute("SELECT h FROM level").fetchall()[0][0]

    def sides(self):
        """Level by level upwards, with ``side`` as a table: (idx, before, after) of the level's nodes."""
        run = f"coalesce(string_agg(h, '') OVER (PARTITION BY idx // {FAN} ORDER BY idx ROWS BETWEEN"
        for _ in range(self.levels):
            self.sql.execute(f"CREATE OR REPLACE TABLE side AS SELECT idx, {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM level")
            yield
            self.climb()


def blocks(nodes: DataFrame, full: int) -> DataFrame:
    return nodes.withColumn("blk", F.expr(f"idx div {full}"))


def block_roots(nodes: DataFrame, full: int = BLOCK) -> DataFrame:
    """(grp, idx, h): the roots of the blocks of nodes (grp, idx, h), numbered by block."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        with Engine(block, full) as engine:
            return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "idx": pa.array([key[1].as_py()], pa.int64()), "h": pa.array([engine.root()], pa.string())})

    return blocks(nodes.select("grp", "idx", "h"), full).groupBy("grp", "blk").applyInArrow(run, "grp string, idx long, h string")


def block_paths(nodes: DataFrame, full: int = BLOCK) -> DataFrame:
    """(grp, idx, path): the way from each node (grp, idx, h) to the root of its block."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        with Engine(block, full) as engine:
            engine.sql.execute("CREATE TABLE way AS SELECT idx, idx AS node, CAST([] AS STRUCT(before VARCHAR, after VARCHAR)[]) AS path FROM block")
            for _ in engine.sides():
                engine.sql.execute(f"CREATE OR REPLACE TABLE way AS SELECT w.idx, node // {FAN} AS node, list_append(path, {{'before': before, 'after': after}}) AS path FROM way w JOIN side s ON s.idx = node")
            out = engine.sql.sql("SELECT idx, path FROM way").to_arrow_table()
        return out.add_column(0, "grp", pa.array([key[0].as_py()] * len(out), pa.string())).cast(pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))]))

    return blocks(nodes.select("grp", "idx", "h"), full).groupBy("grp", "blk").applyInArrow(run, f"grp string, idx long, path {PATH}")


def layers(scratch: Scratch, nodes: DataFrame, full: int = BLOCK) -> list[DataFrame]:
    """The nodes (grp, idx, h) and, layer by layer, the roots of their blocks, until each group is one node."""
    out = [nodes]
    while True:
        out.append(scratch.save(block_roots(out[-1], full)))
        if out[-1].where("idx > 0").isEmpty():
            return out


def paths(scratch: Scratch, tiers: list[DataFrame], top: DataFrame, full: int = BLOCK) -> DataFrame:
    """(grp, idx, path) of the first tier's nodes, from those of the last's (``top``)."""
    for nodes in reversed(tiers[:-1]):
        up = top.select("grp", F.col("idx").alias("blk"), F.col("path").alias("up"))
        own = blocks(block_paths(nodes, full), full).join(up, ["grp", "blk"])
        top = scratch.save(own.select("grp", "idx", F.concat("path", "up").alias("path")))
    return top


def folded(rows: DataFrame, tops: DataFrame, root: str | None, full: int = BLOCK) -> DataFrame:
    """The proofs of rows (grp, blk, idx, doc_id, leaf, seen), each folded from the leaf that is ``seen``;
    tops (grp, blk, subroot, path) has the way from each block up."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(block: pa.Table, top: pa.Table) -> pa.Table:
        way, subroot = top["path"][0].as_py(), top["subroot"][0].as_py()
        with Engine(block.select(["idx", "leaf"]).rename_columns(["idx", "h"]), full) as engine:
            engine.sql.register("given", block)
            engine.sql.execute("CREATE TABLE proof AS SELECT idx AS node, doc_id, leaf, seen AS fold, '' AS siblings FROM given")
            for _ in engine.sides():
                engine.sql.execute(f"CREATE OR REPLACE TABLE proof AS SELECT node // {FAN} AS node, doc_id, leaf, sha256(before || fold || after) AS fold, siblings || before || after AS siblings FROM proof JOIN side ON side.idx = node")
            for s in way:
                engine.sql.execute("UPDATE proof SET fold = sha256(? || fold || ?)", [s["before"], s["after"]])
            outer = "".join(s["before"] + s["after"] for s in way)
            return engine.sql.sql(
                "SELECT CAST(doc_id AS BIGINT) AS doc_id, leaf, CAST(? AS VARCHAR) AS subroot, CAST(? AS VARCHAR) AS root, sha256(siblings || CAST(? AS VARCHAR)) AS proof_sha256, fold AS folded_root, fold = CAST(? AS VARCHAR) AS verified FROM proof",
                params=[subroot, root, outer, root],
            ).to_arrow_table()

    left = blocks(rows, full).select("grp", "blk", "idx", "doc_id", "leaf", "seen").groupBy("grp", "blk")
    return left.cogroup(tops.groupBy("grp", "blk")).applyInArrow(run, schema)


def manifest(scratch: Scratch, docs: DataFrame, tampered: Column | None = None, full: int = BLOCK) -> DataFrame:
    """One row a row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot (of its
    source), root, proof_sha256 (of the siblings from the leaf up to the root), folded_root
    (from the leaf as seen after tampering) and verified (it equals root). A block has ``full`` nodes, a power of 16."""
    rows = numbered(scratch, leaves(docs, tampered))
    inner = layers(scratch, rows.withColumnRenamed("leaf", "h").select("grp", "idx", "h"), full)
    sources = ranked(scratch, inner[-1].select(F.col("grp").alias("name"), "h"), "name", name="idx")
    sources = scratch.save(sources.select(F.lit("").alias("grp"), "idx", "h", "name"))
    outer = layers(scratch, sources.select("grp", "idx", "h"), full)
    root = outer[-1].first()
    ways = paths(scratch, outer, outer[-1].select("grp", "idx", F.expr(f"cast(array() as {PATH})").alias("path")), full)
    tops = sources.join(ways, ["grp", "idx"]).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"), "path")
    subroots = sources.select(F.col("name").alias("grp"), F.col("h").alias("subroot"))
    up = paths(scratch, inner[1:], tops, full).withColumnRenamed("idx", "blk").join(subroots, "grp")
    return folded(rows, up, root and root["h"], full)


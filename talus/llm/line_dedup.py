"""Line deduplication over levelled sorted runs of line hashes; DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lower-cased; keys are compared by 128 bits
of two hashes. Documents come in batches by descending doc_id. A batch is merge-anti-joined to the
runs of all batches before it: what they lack is new, and becomes a run of its own, sorted by hash in
a fixed number of buckets, so that no run is shuffled again; what they hold is only tallied. Once a
level has ``fan`` runs they are compacted to one run of the next. So each key is in one run once, with the
largest document that holds it. Runs and tallies together say which keys are frequent.

Frequent keys meet the lines by a join; those that most lines have are looked up in place. The
positions of dropped lines then meet the texts, which move once.

Defined cases: a null text counts as empty, which is one empty line; rows with a null doc_id
belong to no document: they count for no key, and lose their lines of frequent keys; rows that share a doc_id
are one document; equal lines of the document that keeps a key all stay; very long texts and lines are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.scratch import Scratch

WHITE = " \t\n\x0b\x0c\r"
#: Code points of a key at least, and documents that hold it at least, for its lines to be dropped.
LEAST, DOCS = 40, 5
#: At most so many keys are broadcast; any other key has under one line of so many.
HOT = 20_000
HASH = ["h1", "h2"]


def lines_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, row, pos, h1, h2): the lines with keys of ``least`` code points; ``row`` tells rows apart
    that share a doc_id."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select("doc_id", F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = F.translate(F.trim("line", F.lit(WHITE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = each.where(F.length("line") >= least).select("doc_id", "row", "pos", key.alias("key")).where(F.length("key") >= least)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class Runs:
    """Sorted runs (h1, h2, docs, lines, keep) by level, each key in one of them only. Runs are tables
    in the shared folder, bucketed and sorted by hash."""

    def __init__(self, scratch: Scratch, buckets: int, fan: int = 2):
        self.scratch, self.buckets, self.fan = scratch, buckets, fan
        self.levels: list[list[DataFrame]] = []
        self.name = f"runs_{uuid.uuid4().hex}"
        self.n = 0

    def write(self, rows: DataFrame) -> DataFrame:
        self.n += 1
        name, path = f"{self.name}_{self.n}", f"{self.scratch.root}/{self.name}/{self.n}"
        dealt = rows.repartition(self.buckets, *HASH)
        dealt.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        out = self.scratch.spark.table(name)
        out._talus_path, out._talus_name = path, name
        return out

    def forget(self, *runs: DataFrame) -> None:
        for r in runs:
            self.scratch.spark.sql(f"DROP TABLE {r._talus_name}")
        self.scratch.drop(*runs)

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def lacking(self, rows: DataFrame) -> DataFrame:
        """The rows whose hashes no run has: one merge anti-join a run, in the runs' own order."""
        for run in self.all():
            rows = rows.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        return rows

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch, one row a key, as a run of what is new in it; returns the rest of it, saved."""
        if not self.all():
            self.push(self.write(batch), 0)
            return self.scratch.save(batch.limit(0))
        mine = self.write(batch)
        new = self.write(self.lacking(mine))
        known = self.scratch.save(mine.join(new.select(*HASH).hint("merge"), HASH, "left_anti"))
        self.forget(mine)
        self.push(new, 0)
        return known

    def push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan:
            full, self.levels[level] = self.levels[level], []
            rows = full[0]
            for r in full[1:]:
                rows = rows.unionByName(r)
            merged = self.write(rows)
            self.forget(*full)
            self.push(merged, level + 1)


def bounds(docs: DataFrame, batches: int) -> list[int]:
    """doc_ids that cut ``docs`` in about equal batches, from the largest down."""
    marks = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    return sorted(set(marks or []), reverse=True)


def frequent(scratch: Scratch, lines: DataFrame, marks: list[int], least: int, fan: int) -> DataFrame:
    """(h1, h2, keep, lines): the keys that ``least`` documents hold, the largest of them, and all lines
    of the key. ``lines`` has the batch of each row."""
    spark: SparkSession = scratch.spark
    runs = Runs(scratch, int(spark.conf.get("spark.sql.shuffle.partitions")), fan)
    tallies = None
    for k in range(len(marks) + 1):
        mine = lines.where(F.col("batch") == k).groupBy(*HASH)
        keys = mine.agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("lines"), F.max("doc_id").alias("keep"))
        known = runs.add(keys).select(*HASH, "docs", "lines")
        tallies = known if tallies is None else tallies.unionByName(known)
    more = tallies.groupBy(*HASH).agg(F.sum("docs").alias("d"), F.sum("lines").alias("l"))
    parts = []
    for run in runs.all():
        both = run.join(more.hint("merge"), HASH, "left").withColumns({"docs": F.col("docs") + F.coalesce("d", F.lit(0)), "lines": F.col("lines") + F.coalesce("l", F.lit(0))})
        parts.append(scratch.save(both.where(F.col("docs") >= least).select(*HASH, "keep", "lines")))
    runs.forget(*runs.all())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dropped(lines: DataFrame, keys: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, row, gone): the positions of the lines that go, in order."""
    total = lines.count()
    often = F.broadcast(keys.where(F.col("lines") * hot >= total).drop("lines"))  # at most ``hot`` keys
    rare = keys.where(F.col("lines") * hot < total).drop("lines")
    cold = lines.join(often.select(*HASH), HASH, "left_anti").join(rare, HASH)
    met = lines.join(often, HASH).unionByName(cold).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    # Rows that repeat both doc_id and text have the same lines: one of each position.
    return met.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def kept(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with ``lines``, those that stay, and ``gone``: what stands between dropped positions is taken in
    stretches, so the work is linear in the lines."""
    text = F.coalesce("text", F.lit(""))
    mine = docs.select("doc_id", "text", F.xxhash64(text).alias("row"))
    g = gone.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "gone")
    both = mine.join(g, mine.doc_id.eqNullSafe(g["_doc"]) & (mine.row == g["_row"]), "left")

    def stretches(lines):  # ``lines`` is bound once here, not split anew for each stretch
        ends = F.concat("gone", F.array(F.size(lines)))
        starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
        return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.slice(lines, z["s"] + 1, z["e"] - z["s"]))

    split = F.array(F.split(text, "\n", -1))
    return both.select(
        "doc_id",
        F.element_at(F.transform(split, lambda lines: F.size(lines)), 1).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.flatten(F.element_at(F.transform(split, stretches), 1)), "\n")).alias("text"),
    )


def drop_lines(scratch: Scratch, docs: DataFrame, batches: int = 4, fan: int = 2, least: int = LEAST, shared: int = DOCS, hot: int = HOT) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped, and the text without lines
    whose key ``shared`` documents hold, but for the largest of them."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    marks = bounds(docs, batches)
    batch = F.lit(0)
    for m in marks:
        batch = batch + F.when(F.coalesce(F.col("doc_id") > m, F.lit(False)), 0).otherwise(1)
    lines = scratch.save(lines_of(docs, least).withColumn("batch", batch))
    keys = frequent(scratch, lines, marks, shared, fan)
    return kept(docs, dropped(lines.drop("batch"), keys, hot))


def digests(scratch: Scratch, docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out = drop_lines(scratch, docs, **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))

"""A stored full-text index with positions: built once, asked many times.

Postings (shard, term, col, id, positions) lie in a folder by shard of the term, in order of term within a file, so a
question reads the shards of its terms only, and of those the row groups that may hold them. Phrases are
looked up: the asked words of each row are laid out again by position, and what stands side by side there meets all phrases
at once, so the work grows with the words and not with the questions that ask for them. Lengths (id, len) and one row of totals stand beside the postings.

A question has words, "phrases" and column:word or column:"phrase"; words side by side and AND must all be there,
NOT takes away, and OR parts alternatives. Whatever else it holds is read as words.

Defined cases: null texts have no words; rows that share an id are one row, in which no phrase goes from one text to the next; a question without words finds nothing;
of equal scores the smaller id comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.operators.retrieval import top
from talus.operators.sparse import listed
from talus.shared import cut

WORD = r"[\p{L}\p{N}_]+"
SHARDS = 64
#: Postings of a file at most, and rows whose words are gathered at once.
FILE, ROWS = 1 << 19, 1000
CLAUSES = "query long, grp int, clause int, negative boolean, col string, size int, place int, term string"
#: Of the ranking: weight of repeats, weight of length, and the least weight of a word that most rows hold.
K1, B, LEAST = 1.2, 0.75, 1e-6


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def shard_of(term: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, col, term, positions) of rows (id, col, base, w): each word of a row once, with its places from ``base`` on."""
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            part = batch.slice(s, ROWS)
            row, values = listed(part.column(3))
            if not len(row):
                continue
            place = np.arange(len(row)) - np.searchsorted(row, row) + np.asarray(part.column(2))[row]
            coded = values.dictionary_encode()
            key = row * len(coded.dictionary) + np.asarray(coded.indices)
            turn = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.diff(key[turn], prepend=-1))
            at = turn[start]
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(turn)), pa.int32()), pa.array(place[turn], pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[at])), part.column(1).take(pa.array(row[at])), values.take(pa.array(at)), lists], ["id", "col", "term", "positions"])


def build(rows: DataFrame, key: str, columns: list[str], path: str, shards: int = SHARDS) -> None:
    """Writes the index of text columns of ``rows`` to a folder. Ranges of (shard, term, id) are the files, so
    a word that every row holds is many files."""
    each = rows.select(F.col(key).alias("id"), F.inline(F.array(*(F.struct(F.lit(c).alias("col"), words(F.col(c)).alias("w")) for c in columns))))
    repeated = not rows.groupBy(key).agg(F.count("*").alias("k")).where("k > 1").isEmpty()
    before = Window.partitionBy("id", "col").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.size("w") + 1).over(before), F.lit(0)) if repeated else F.lit(0)
    kind = each.schema["id"].dataType.simpleString()
    lists = each.select("id", "col", base.cast("long").alias("base"), "w").mapInArrow(gathered, f"id {kind}, col string, term string, positions array<int>")
    if repeated:
        lists = lists.groupBy("id", "col", "term").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    lists = cut(lists.withColumn("shard", shard_of(F.col("term"), shards)))
    order = ("shard", "term", "id", "col")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), lists.count() // FILE + 1)
    lists.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
    size = sum((F.size(words(F.col(c))) for c in columns), F.lit(0))
    sizes = rows.groupBy(F.col(key).alias("id")).agg(F.sum(size).alias("len"))
    sizes.write.mode("overwrite").parquet(f"{path}/lengths")
    rows.sparkSession.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.avg("len").alias("mean"), F.lit(shards).alias("shards")).write.mode("overwrite").parquet(f"{path}/totals")


def clauses_of(questions: dict[int, str], columns: list[str]) -> list[tuple]:
    """Rows CLAUSES of questions: a question is groups, of which one must be met; a group is clauses."""
    out = []
    for query, text in questions.items():
        grp, clause, negative = 0, 0, False
        for name, phrase, word in re.findall(r'(?:(\w+):)?(?:"([^"]*)"|(\w+))', text):
            if not name and word.upper() in ("AND", "OR", "NOT"):
                grp, negative = (grp + 1 if word.upper() == "OR" and clause else grp), word.upper() == "NOT" and clause > 0
                continue
            col, said = (name, phrase or word) if name in columns else (None, f"{name} {phrase or word}")
            terms = re.findall(r"\w+", said.lower())
            out += [(query, grp, clause, negative, col, len(terms), k, t) for k, t in enumerate(terms)]
            clause, negative = clause + 1, False
    return out


def phrases_of(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Rows CLAUSES: the first ``size`` words of each text as a phrase."""
    first = F.slice(words(F.col(text)), 1, size)
    each = rows.select(F.col(key).cast("long").alias("query"), first.alias("w")).select("query", F.size("w").alias("size"), F.posexplode("w").alias("place", "term"))
    fixed = [F.lit(0).alias("grp"), F.lit(0).alias("clause"), F.lit(False).alias("negative"), F.lit(None).cast("string").alias("col")]
    return each.select("query", *fixed, "size", "place", "term")


def postings(spark: SparkSession, path: str) -> DataFrame:
    kind = spark.read.parquet(f"{path}/lengths").schema["id"].dataType.simpleString()
    return spark.read.schema(f"id {kind}, col string, term string, positions array<int>, shard int").parquet(f"{path}/postings")


def ask(spark: SparkSession, path: str, questions: dict[int, str], columns: list[str], k: int = 20) -> DataFrame:
    """(query, id, score, rank): the best ``k`` rows of each question."""
    said = clauses_of(questions, columns)
    shards = spark.read.parquet(f"{path}/totals").first()["shards"]
    asked = spark.createDataFrame(said, CLAUSES)
    terms = sorted({r[-1] for r in said})
    spots = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(shard_of(F.col("t"), shards)).distinct().collect()]
    held = postings(spark, path).where(F.col("shard").isin(spots) & F.col("term").isin(terms))
    return answer(spark, path, held, F.broadcast(asked), k)  # the words that the caller wrote


def ask_all(spark: SparkSession, path: str, asked: DataFrame, k: int = 20) -> DataFrame:
    """The same for clauses (CLAUSES) in a table of any size, which is joined to the postings."""
    return answer(spark, path, postings(spark, path), cut(asked), k)


def phrases(held: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """(key ..., negative, id, f): how often a row holds the phrase of a clause of several words (``asked``, which has
    some). A row's asked words stand in order of position; from each that begins a phrase on, as many as a
    phrase has are put together where no other word lies between."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " ")
    wanted = asked.groupBy(*key, "negative", "want", "size").agg(said.alias("said"))
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())  # one number a length
    terms = asked.groupBy("term").agg(F.max(F.col("place") == 0).alias("first"))
    spots = F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("term"), F.col("first")))))
    rows = held.join(terms, "term").groupBy("id", "col").agg(F.array_sort(spots).alias("w"))

    def grams(n: int) -> Column:
        def at(x: Column, i: Column) -> Column:
            near = F.col("w")[i + (n - 1)]["pos"] == x["pos"] + (n - 1)
            return F.when(x["first"] & near, F.array_join(F.transform(F.slice("w", i + 1, n), lambda y: y["term"]), " "))

        return F.array_compact(F.transform(F.slice("w", 1, F.greatest(F.size("w") - (n - 1), F.lit(0))), at))

    found = rows.select("id", "col", F.explode(F.concat(*map(grams, sizes))).alias("said"))
    found = found.join(wanted.select("said").distinct(), "said", "left_semi").groupBy("id", "col", "said").agg(F.count("*").alias("f"))
    return found.join(wanted, "said").where(F.col("want").isNull() | (F.col("want") == F.col("col"))).select(*key, "negative", "id", "f")


def answer(spark: SparkSession, path: str, held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    key = ["query", "grp", "clause"]
    c = asked.withColumnRenamed("col", "want")
    met = held.join(c.where("size = 1"), "term").where(F.col("want").isNull() | (F.col("want") == F.col("col")))
    found = met.select(*key, "negative", "id", F.size("positions").cast("long").alias("f"))
    if not c.where("size > 1").isEmpty():
        found = found.unionByName(phrases(held, c.where("size > 1"), key))
    found = cut(found.groupBy(*key, "negative", "id").agg(F.sum("f").alias("f")))
    wanted = asked.select(*key, "negative").distinct().groupBy("query", "grp").agg(F.count_if(~F.col("negative")).alias("wanted"))
    groups = found.groupBy("query", "grp", "id").agg(F.count_if(~F.col("negative")).alias("had"), F.count_if("negative").alias("barred"))
    hits = groups.join(wanted, ["query", "grp"]).where("had = wanted and barred = 0").select("query", "id").distinct()
    totals = spark.read.parquet(f"{path}/totals").first()
    n, mean = totals["n"], totals["mean"] or 1.0
    df = found.groupBy(*key).agg(F.count("*").alias("df"))
    idf = F.greatest(F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    lengths = spark.read.parquet(f"{path}/lengths")
    scored = found.join(hits, ["query", "id"], "left_semi").join(df, key).join(lengths, "id")
    return top(scored.groupBy("query", "id").agg(F.round(F.sum(part), 6).alias("score")), "query", "score", "id", k)

"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Base rules find spans in every whole text. A further rule proposes opaque tokens
(long, with upper case, lower case and digits), which alone would flag far too
much; the corpus decides: each candidate's hash is counted over distinct repositories
and distinct owners, and an opaque token stays only where a single owner has it, in no
more than ``repositories_at_most`` of its repositories: what an owner spreads over more is
a placeholder. The same counts divide the base spans into live-looking ones and copied
ones (examples that many owners or repositories repeat). Base spans always stay.

Positions: a pattern's leftmost non-overlapping matches and the pieces between
them alternate, so running lengths of ``split`` and ``regexp_extract_all`` give
start and end in code points, by one window over a text's matches.

By default a document's ``source`` is the owner and the document the repository.
Defined cases: a null text counts as empty and has no spans; a null owner is an
owner of its own; rows that repeat a doc_id are rows of their own (and one repository); very
long texts are read whole; spans that start together go in the order of the rules; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.scratch import Scratch, join_hot

# Kind, pattern, group that holds the secret, least length of that group.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("opaque", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
)
BASE = 3  # of the rules; the rest only propose


def matches(text: Column, order: int) -> Column:
    """array<struct<ord, k, gap, size, value>> of one rule's matches in ``text``: the k-th has ``gap`` code
    points before it, from the end of the one before, and ``size`` of its own."""
    _, pattern, group, _ = RULES[order]
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    each = F.transform(pieces, lambda x, k: F.struct(F.lit(order).alias("ord"), k.alias("k"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size"), x["value"].alias("value")))
    empty = F.expr("cast(array() as array<struct<ord:int,k:int,gap:int,size:int,value:string>>)")
    return F.when(text.rlike(pattern), F.filter(each, lambda x: x["size"].isNotNull())).otherwise(empty)


def spans(rows: DataFrame) -> DataFrame:
    """Of rows (uid, matches, ...) one row a span: the others, ord, start, end and value. Positions are running
    sums over the matches of a rule in a text, so the work is linear in them. Opaque tokens need all three
    kinds of letters and must be apart from base spans, which the ones before and after in the text tell."""
    each = rows.repartition("uid").select(*(c for c in rows.columns if c != "matches"), F.inline("matches"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("uid", "ord").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    least = F.element_at(F.array(*(F.lit(r[3]) for r in RULES)), F.col("ord") + 1)
    mixed = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")
    each = each.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("size"))
    each = each.where((F.length("value") >= least) & ((F.col("ord") < BASE) | mixed)).drop("k", "gap", "size")
    text = Window.partitionBy("uid")
    upto = lambda order: text.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # noqa: E731  the other way round costs the square
    base = lambda c: F.when(F.col("ord") < BASE, F.col(c))
    reached = F.max(base("end")).over(upto(F.asc("start")))
    coming = F.min(base("start")).over(upto(F.desc("start")))
    met = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(coming < F.col("end"), F.lit(False))
    return each.withColumn("met", met).where((F.col("ord") < BASE) | ~F.col("met")).drop("met")


def written(found: Column) -> Column:
    """kind:start:end of each span (start, ord, end) by start, then kind, joined by commas."""
    names = F.array(*(F.lit(r[0]) for r in RULES))
    one = lambda x: F.concat_ws(":", F.element_at(names, x["ord"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.coalesce(F.array_join(F.transform(F.array_sort(found), one), ","), F.lit(""))


def scan(scratch: Scratch, docs: DataFrame, owner: str = "source", repository: str = "doc_id", owners_at_most: int = 1, repositories_at_most: int = 8) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_live and n_copied (base spans by ownership), n_opaque (spans added)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col(owner).alias("owner"), F.col(repository).cast("string").alias("repo"), text.alias("text"))
    rows = rows.withColumn("matches", F.concat(*(matches(F.col("text"), k) for k in range(len(RULES))))).drop("text")
    rows = scratch.save(rows.withColumn("uid", F.monotonically_increasing_id()))
    each = scratch.save(spans(rows.select("uid", "owner", "repo", "matches").where(F.size("matches") > 0)).withColumn("h", F.sha2("value", 256)).drop("value"))
    held = each.select("h", "owner", "repo").distinct().groupBy("h", "owner").agg(F.count("*").alias("n"))
    often = held.groupBy("h").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    judged = join_hot(each, often, "h", F.col("uid")).withColumn("live", (F.col("owners") <= owners_at_most) & (F.col("repositories") <= repositories_at_most))
    is_base, span = F.col("ord") < BASE, F.struct("start", "ord", "end")
    n = lambda c: F.count_if(c)
    by_row = judged.groupBy("uid").agg(
        *(n(F.col("ord") == k).alias(f"n_{RULES[k][0]}") for k in range(BASE)),
        F.collect_list(F.when(is_base, span)).alias("base"), F.collect_list(F.when(is_base | F.col("live"), span)).alias("shown"),
        n(is_base & F.col("live")).alias("n_live"), n(is_base & ~F.col("live")).alias("n_copied"), n(~is_base & F.col("live")).alias("n_opaque"),
    )
    out = rows.select("uid", "doc_id").join(by_row, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("shown")).alias("spans"), zero("n_live"), zero("n_copied"), zero("n_opaque"),
    )

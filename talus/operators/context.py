"""Context of a task: item scores and actions, consistency of claims, intents, packing, tool results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.shared import cut

# Points of an item by class and by source, and of its age.
CLASS_POINTS = {"user_intent": 0.3, "task_state": 0.3, "constraint": 0.3, "plan": 0.3, "fact": 0.2, "evidence": 0.2, "source_code": 0.2, "memory": 0.1, "decision": 0.1}
SOURCE_POINTS = {"graph": 0.1, "intelligence": 0.1, "memory": 0.05}
TARGET, INTENT_WORD, HOUR, DAY, COPY = 0.4, 0.05, 0.1, 0.05, 0.3
# Verbs of a change, and the categories that they and other words mean.
VERBS = ("add", "remove", "delete", "refactor", "fix", "update", "test", "implement", "migrate", "optimize", "rename")
CATEGORIES = {"feature": "add|implement", "bugfix": "fix", "refactor": "refactor|rename|migrate", "test": "test", "docs": "doc|readme", "config": "config|yaml|json"}
# File name ends that a tool's result refers to.
REFERENCES = r"\.(go|py|ts|js|java|rs|rb|php|c|cpp|h|md|yaml|yml|json)$"


def points(table: dict[str, float], key: Column) -> Column:
    out = F.lit(0.0)
    for name, value in table.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def item_score(intent: str, target: str, now: str) -> Column:
    """0 to 1 for items (content, class, source, fresh): the target and the intent's longer words in
    the content, the class, the age at ``now`` and the source."""
    text = F.lower(F.coalesce("content", F.lit("")))
    score = F.when(F.contains(text, F.lit(target.lower())), TARGET).otherwise(0.0) if target else F.lit(0.0)
    for word in (w for w in intent.lower().split() if len(w) > 3):
        score = score + F.when(F.contains(text, F.lit(word)), INTENT_WORD).otherwise(0.0)
    age = F.lit(now).cast("timestamp_ntz").cast("timestamp").cast("double") - F.col("fresh").cast("timestamp").cast("double")
    fresh = F.when(age < 3600, HOUR).when(age < 86400, DAY).otherwise(0.0)
    return F.least(F.lit(1.0), score + points(CLASS_POINTS, F.col("class")) + fresh + points(SOURCE_POINTS, F.col("source")))


def item_actions(items: DataFrame, intent: str, target: str, now: str, most: int) -> DataFrame:
    """(id, score, action) of items (id, digest, content, class, source, fresh): later copies of a
    digest keep 0.3 of their score; the best ``most`` are kept (compressed under 0.2), the others
    demoted (archived under 0.3, dropped under 0.1). Ranks come from a cut by score: the rows at
    the cut are few, so no window sees all items."""
    first = items.where("digest <> ''").groupBy("digest").agg(F.min("id").alias("first"))
    score = F.round(item_score(intent, target, now) * F.when(F.col("first").isNotNull() & (F.col("id") != F.col("first")), COPY).otherwise(1.0), 6)
    rows = items.join(first, "digest", "left").select("id", score.alias("score"))
    best = rows.orderBy(F.desc("score"), "id").limit(most).agg(F.min("score").alias("bar"), F.max_by("id", F.struct(-F.col("score"), F.col("id"))).alias("last"))
    out = rows.crossJoin(F.broadcast(best))  # one row
    top = (F.col("score") > F.col("bar")) | ((F.col("score") == F.col("bar")) & (F.col("id") <= F.col("last")))
    rest = F.when(F.col("score") < 0.1, "DROP").when(F.col("score") < 0.3, "ARCHIVE").otherwise("DEMOTE")
    action = F.when(top, F.when(F.col("score") < 0.2, "COMPRESS").otherwise("KEEP")).otherwise(rest)
    return out.select("id", "score", action.alias("action"))


def conflicts(claims: DataFrame) -> DataFrame:
    """(scope, conflicts, confidence) of claims (scope, source, statement, confidence): pairs of
    different sources that say different things of a scope, and half of the least confidence in them.
    Pairs are counted, not made: by statement and source."""
    scope = F.coalesce(F.nullif(F.trim("scope"), F.lit("")), F.lit("_global_"))
    c = claims.select(scope.alias("scope"), "source", F.lower(F.trim("statement")).alias("s"), "confidence")
    cell = c.groupBy("scope", "source", "s").agg(F.count("*").alias("n"), F.min("confidence").alias("least"))
    by = lambda *k: F.sum("n").over(Window.partitionBy("scope", *k))
    others = by() - by("source") - by("s") + F.col("n")
    cell = cell.withColumn("others", others).where("others > 0")
    return cell.groupBy("scope").agg((F.sum(F.col("n") * F.col("others")) / 2).cast("long").alias("conflicts"), F.round(F.min("least") * 0.5, 6).alias("confidence"))


def intent_verbs(text: Column) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, VERBS)), lambda v: F.contains(low, v))


def intent_categories(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(c)) for c, p in CATEGORIES.items())))


def intent_targets(text: Column) -> Column:
    """Quoted words and paths, then words with both cases of letters, each once."""
    trim = lambda w: F.regexp_replace(w, r"""^["'.,;:()\[\]{}\s]+|["'.,;:()\[\]{}\s]+$""", "")
    marked = F.filter(F.split(text, "[ ,;\t]+"), lambda w: w.rlike("[\"'/]"))
    mixed = F.filter(F.split(text, r"\s+"), lambda w: w.rlike("[A-Z]") & w.rlike("[a-z]"))
    every = F.filter(F.transform(F.concat(marked, mixed), trim), lambda w: w != "")
    known = lambda acc, w: F.exists(acc, lambda x: F.lower(x) == F.lower(w))
    return F.aggregate(every, F.expr("cast(array() as array<string>)"), lambda acc, w: F.when(known(acc, w), acc).otherwise(F.concat(acc, F.array(w))))


def tool_summary(raw: Column, most: int = 5) -> Column:
    """struct(summary, errors, facts, evidence, refs, saved) of a tool's output."""
    bare = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    errors = F.filter(bare, lambda x: F.lower(x).rlike("error|fail|panic|fatal"))
    facts = F.filter(bare, lambda x: x.rlike(" = |:=|type |func "))
    evidence = F.filter(bare, lambda x: x.rlike("[^ :]:[0-9]"))
    fields = F.transform(F.split(raw, r"\s+"), lambda w: F.regexp_replace(w, r"""[,;:()\[\]{}"']+$""", ""))
    refs = F.array_distinct(F.filter(fields, lambda w: w.rlike(REFERENCES)))
    summary = F.array_join(F.slice(bare, 1, most), "\n")
    saved = F.greatest(F.floor(F.octet_length(raw) / 4) - F.floor(F.octet_length(summary) / 4), F.lit(0))
    return F.struct(summary.alias("summary"), errors.alias("errors"), facts.alias("facts"), evidence.alias("evidence"), refs.alias("refs"), saved.cast("long").alias("saved"))


def sums_before(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (pos, bucket, n, ...) with ``before``: the sum of n over rows of the same keys at smaller positions. One window
    a bucket, and one over a row a bucket."""
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.sum("s").over(to_here(Window.partitionBy(*keys).orderBy("bucket")))
    starts = rows.groupBy(*keys, "bucket").agg(F.sum("n").alias("s")).select(*keys, "bucket", F.coalesce(offset, F.lit(0)).alias("offset"))
    inside = F.sum("n").over(to_here(Window.partitionBy(*keys, "bucket").orderBy("pos")))
    return rows.join(starts, [*keys, "bucket"]).withColumn("before", F.col("offset") + F.coalesce(inside, F.lit(0))).drop("offset")


def pack(files: DataFrame, budget: int, reserve: int = 200) -> DataFrame:
    """(path, tokens, taken, before) of files (path, tokens): in order of path, a file is taken where it still fits the
    budget less the reserve; one that does not is passed over, so this is no running sum. Null sizes never fit.

    With a room of 2^k up to 2^(k+1), all files under 2^k fit until less than 2^k is left, so the room before a file is
    a running sum of those. A turn ends at the first file taken that leaves less: the room loses a bit a turn, and there
    are no more turns than the budget has bits. Only buckets in which the turn may end are looked into."""
    size = F.col("tokens")
    line = files.select("path", size.cast("long").alias("tokens")).repartitionByRange("path").sortWithinPartitions("path")
    line = cut(line.withColumn("pos", F.monotonically_increasing_id()).withColumn("bucket", F.shiftright("pos", 33)))
    room, start, turns = budget - reserve, -1, []
    while True:
        step = 1 << max(room, 1).bit_length() - 1
        turns.append((room, step, start))
        if room <= 0:
            break
        n = F.when(size < step, size).otherwise(0)
        rows = line.where((F.col("pos") > start) & (size <= room)).withColumn("n", n)
        ends = rows.groupBy("bucket").agg(F.sum("n").alias("s"), F.min(F.when(size >= step, size)).alias("least"))
        offset = F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = ends.withColumn("offset", offset).where(f"offset + s > {room - step} or least <= {room} - offset")
        inside = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = room - F.col("offset") - inside - size
        end = rows.join(ends.select("bucket", "offset"), "bucket").select("pos", left.alias("left")).where(f"left >= 0 and left < {step}").agg(F.min(F.struct("pos", "left")).alias("end")).first()["end"]
        if end is None:
            break
        start, room = end["pos"], end["left"]
    turn = F.lit(0)
    for k, (_, _, after) in enumerate(turns[1:], 1):
        turn = F.when(F.col("pos") > after, k).otherwise(turn)
    of_turn = lambda k: F.element_at(F.array(*(F.lit(t[k]).cast("long") for t in turns)), F.col("turn") + 1)
    known = line.withColumn("turn", turn).withColumn("room", of_turn(0)).withColumn("step", of_turn(1))
    small = (size < F.col("step")) & (F.col("room") >= 0)
    known = sums_before(known.withColumn("n", F.when(small, size).otherwise(0)), "turn")
    taken = F.coalesce(small | (size <= F.col("room") - F.col("before")), F.lit(False))
    return known.select("path", "tokens", taken.alias("taken"), (F.lit(budget - reserve) - F.col("room") + F.col("before")).alias("before"))


def bundle(files: DataFrame, packed: DataFrame) -> DataFrame:
    """(path, part): the text of each packed file (path, text) under a header that names it; joined in order of path they are the bundle."""
    part = F.concat(F.lit("===== "), "path", F.lit(" =====\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return files.join(packed.where("taken").select("path"), "path").select("path", part.alias("part")).orderBy("path")


def packet_metrics(packets: DataFrame) -> DataFrame:
    """(packet, items, tokens, classes, sources) of packets' items (packet, class, source, tokens)."""
    return packets.groupBy("packet").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.countDistinct("class").alias("classes"), F.countDistinct("source").alias("sources"))


def swap_fences(texts: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """(id, text): texts (id, text, tokens) of more than ``most`` tokens, with the fences tagged
    'lang:path' turned into one line that names the file and its symbols (path, summary)."""
    fence = r"```[a-z]+:([^\s`]+)\n[\s\S]*?```"
    named = texts.where(F.col("tokens") > most).select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(fence), F.lit(1)))).alias("path"))
    found = named.join(files, "path").groupBy("id").agg(F.collect_list(F.struct("path", "summary")).alias("s"))
    short = F.aggregate("s", F.col("text"), lambda t, f: F.regexp_replace(t, F.concat(F.lit("```[a-z]+:\\Q"), f["path"], F.lit("\\E\n[\\s\\S]*?```")), F.concat(F.lit("["), F.regexp_replace(f["path"], r"([\\$])", r"\\$1"), F.lit(": "), F.regexp_replace(f["summary"], r"([\\$])", r"\\$1"), F.lit("]"))))
    return texts.join(found, "id", "left").select("id", F.when(F.col("s").isNull(), F.col("text")).otherwise(short).alias("text"))

"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

A document's size is its number of words. Sources, in code point order (null last), weigh 5, 2, 1, repeating, and share
`budget` times the size of all documents; a source's target stops at `most` times its size, and what it leaves is shared
again by weight until none is above. A source is taken whole as often as its target allows; of the rest, documents are
taken by hash. Sizes are summed by source and the first BITS bits of the hash, the bucket in which the budget ends is
found, and only the rows of that bucket are summed by the next BITS bits, until one hash is left. So nothing is sorted,
a source is never in one task, and thresholds are nested: a larger budget takes all that a smaller one takes. Of the
document at the threshold as many words are taken as are missing, so that sums meet targets to the word.

Hashes depend on id and text, so reruns agree. Rows with the same id and text have one hash; at the threshold they share
what is missing, rounded down. Null texts have no words; null is a source of its own, as is the empty string; a source
without words has the target 0. An empty table gives no rows. Columns that the result names are replaced, others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolytics.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Bits of a hash, and of it that a histogram counts by.
HASH_BITS, BITS = 60, 10


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fingerprint(id_col: str, text_col: str) -> Column:
    """HASH_BITS bits of the md5 of id and text."""
    parts = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(parts), 1, HASH_BITS // 4), 16, 10).cast("long")


def _key(source: Column) -> Column:
    """A text that is never null and sorts as the sources do, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def weighted(sizes: DataFrame) -> DataFrame:
    """sizes (key, size; a row a source) with weight, by place in the order of keys. Rows are ranked within ranges of
    keys; only how many each range holds reaches the driver."""
    ranged = materialize(sizes.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "mix-sources")
    before, offsets = 0, []
    for part, n in sorted(ranged.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += n
    starts = ranged.sparkSession.createDataFrame(offsets, "part int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return ranged.join(starts, "part").select("key", "size", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS)).cast("int") + 1).cast("long").alias("weight"))


def targets(sizes: DataFrame, budget: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """key, size, target, whole, rest: the words to take of each source, as a number of whole copies and words beside
    them. budget is a fraction. Each round caps the sources above `most` times their size and shares again.

    A round is one aggregation of the sources; the last round's level, two integers, is all that the driver keeps.
    """
    up, down = budget
    rows = materialize(weighted(sizes), "mix-weights")
    big = lambda c: F.col(c).cast("decimal(20,0)")
    total, over, under = int(rows.agg(F.sum(big("size"))).first()[0] or 0), None, 1
    capped = F.lit(False)
    while True:
        cap_sum, free = rows.agg(F.sum(F.when(capped, most * big("size"))), F.sum(F.when(~capped, big("weight")))).first()
        now = (up * total - down * int(cap_sum or 0), down * int(free or 0))
        if now == (over, under) or not now[1]:
            break
        over, under = now
        level = F.lit(str(over)).cast("decimal(28,0)")
        capped = most * big("size") * F.lit(str(under)).cast("decimal(14,0)") < F.col("weight").cast("decimal(2,0)") * level
    if over is None:
        over, under = 0, 1
    share = (F.col("weight").cast("decimal(2,0)") * F.lit(str(over)).cast("decimal(28,0)")).cast("double") / F.lit(float(under))
    target = F.when(capped, (most * F.col("size")).cast("double")).otherwise(share)
    wanted = F.floor("target").cast("long")
    whole = F.when(F.col("size") > 0, F.floor(wanted / F.col("size"))).otherwise(0).cast("long")
    return rows.withColumn("target", target).withColumn("whole", whole).select("key", "size", "target", "whole", (wanted - F.col("whole") * F.col("size")).alias("rest"))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, cut, share, of: documents with a hash below cut are taken once more; those with the hash cut together give
    `share` of their `of` words. sized: key, hash, size; wanted: key, rest. Sources with a rest of 0 have no row."""
    todo = wanted.where("rest > 0").select("key", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("missing"))
    done = None
    for level in range(1, HASH_BITS // BITS + 1):
        shift = HASH_BITS - level * BITS
        inside = sized.join(todo, (sized["key"] == todo["key"]) & (F.shiftright("hash", shift + BITS) == todo["prefix"])).select(sized["key"], "hash", "size", "missing")
        counts = inside.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.first("missing").alias("missing"))
        before = F.sum("n").over(Window.partitionBy("key").orderBy("bucket")) - F.col("n")
        at = counts.withColumn("before", before).where("before < missing and before + n >= missing")
        at = materialize(at.select("key", "bucket", "n", "low", "high", (F.col("missing") - F.col("before")).alias("missing")), "mix-level")
        ready = at.where("low = high").select("key", F.col("low").alias("cut"), F.col("missing").alias("share"), F.col("n").alias("of"))
        done = ready if done is None else done.unionByName(ready)
        todo = at.where("low < high").select("key", F.col("bucket").alias("prefix"), "missing")
        if todo.isEmpty():
            break
    return done


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """docs with size, source_size, target (its source's) and taken: the words that the mix takes of each document, at
    most `most` times its size."""
    own = docs.drop("size", "source_size", "target", "taken", "_key", "_hash").withColumns({"size": words(F.col(text_col)), "_hash": fingerprint(id_col, text_col), "_key": _key(F.col(source_col))})
    sized = materialize(own.select(F.col("_key").alias("key"), F.col("_hash").alias("hash"), "size"), "mix-sizes")
    wanted = materialize(targets(sized.groupBy("key").agg(F.sum("size").alias("size")), budget, most), "mix-targets")
    plan = wanted.join(thresholds(sized, wanted), "key", "left").select(F.col("key").alias("_key"), F.col("size").alias("source_size"), "target", "whole", "cut", "share", "of")
    part = F.floor(F.col("size").cast("decimal(19,0)") * F.col("share").cast("decimal(19,0)") / F.col("of")).cast("long")
    more = F.when(F.col("_hash") < F.col("cut"), F.col("size")).when(F.col("_hash") == F.col("cut"), part).otherwise(F.lit(0))
    return own.join(plan, "_key").withColumn("taken", F.col("whole") * F.col("size") + more).drop("_key", "_hash", "whole", "cut", "share", "of")

"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become words; GRAM consecutive words are hashed; of each WINDOW consecutive hashes the least (leftmost) is kept
as a fingerprint. GRAM + WINDOW - 1 = SPAN words, so every shared span of SPAN words has a fingerprint, at one place of
it, on both sides. Joining the fingerprints gives alignments of documents with items; each is extended word by word,
and all words inside occurrences of SPAN words of an item are hit. Items shorter than SPAN words are one window; all
grams of their length (at most SPAN - 1 lengths) serve as fingerprints for them.

A hash and its position are packed into one long (POSITION_BITS for the position), so that a window's least hash is
one array_min. Fingerprints compare words in lower case; the extension compares them with only A-Z lowered, which is
stricter. The benchmark's fingerprints are joined as Spark sees fit: broadcast only below its size threshold.

Null texts have no words; items without words never occur. Repeated document rows are judged alike, each on its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW, SPAN = 6, 8, 13
#: Room for the positions of all words that a string can hold: it has less than 2**31 bytes, a word and its blank two.
POSITION_BITS = 30
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """All letters in lower case, with one small sigma: which one lower() takes depends on what stands around it."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def words(text: Column, exact: bool = True) -> Column:
    """Words of a text, A-Z in lower case; not exact: all letters in lower case, which is faster."""
    lower = F.translate(text, _UPPER, _LOWER) if exact else lowered(text)
    return F.coalesce(F.array_remove(F.split(lower, SEPARATOR), ""), F.array().cast("array<string>"))


def _positions(last: Column) -> Column:
    """1, ..., last; none if last < 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def grams(ws: Column, n: int) -> Column:
    """For each n consecutive words: their hash in the high bits, their position (from 0) in the low ones."""
    return F.transform(_positions(F.size(ws) - n + 1), lambda i: F.shiftleft(F.xxhash64(F.slice(ws, i, n)), POSITION_BITS).bitwiseOR((i - 1).cast("long")))


def fingerprints(df: DataFrame, ws: str, short: list[int], whole: bool) -> DataFrame:
    """df without ws, with h and pos of each fingerprint of the words in ws.

    short: the lengths below SPAN for which grams are kept too; whole: only those of texts of just that length.
    """
    w, n = F.col(ws), F.size(ws)
    least = F.transform(_positions(F.size("_grams") - WINDOW + 1), lambda i: F.array_min(F.slice("_grams", i, WINDOW)))
    rows = df.withColumn("_grams", grams(w, GRAM))
    none = F.array().cast("array<bigint>")

    def of_kind(kind: int, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))

    kinds = [of_kind(0, F.array_distinct(least))]
    kinds += [of_kind(length, F.when(n == length, grams(w, length)).otherwise(none) if whole else grams(w, length)) for length in short]
    rows = rows.select(*[c for c in df.columns if c != ws], F.explode(F.concat(*kinds)).alias("f"))
    v = F.col("f.v")
    return rows.withColumns({"kind": F.col("f.kind"), "h": F.shiftright(v, POSITION_BITS), "pos": v.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")}).drop("f")


def alignments(docs: DataFrame, items: DataFrame, id_col: str) -> DataFrame:
    """id_col, item_id, shifts: where, by a shared fingerprint, an item may stand in a document."""
    short = sorted(r[0] for r in items.where(F.size("item_words").between(1, SPAN - 1)).select(F.size("item_words")).distinct().collect())
    of_items = fingerprints(items.select("item_id", F.transform("item_words", lowered).alias("ws")), "ws", short, True).withColumnRenamed("pos", "item_pos")
    of_docs = fingerprints(docs.select(id_col, words(F.col("text"), exact=False).alias("ws")), "ws", short, False)
    found = of_docs.join(of_items, ["kind", "h"]).select(id_col, "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
    return found.groupBy(id_col, "item_id").agg(F.collect_set("shift").alias("shifts"))


def _hits(doc: Column, item: Column, shift: Column) -> Column:
    """Document positions inside occurrences of the item's windows at this shift."""
    n = F.size(item)
    span = F.least(n, F.lit(SPAN))
    same = F.transform(item, lambda word, j: F.coalesce(F.get(doc, j + shift) == word, F.lit(False)).cast("int"))
    return F.flatten(F.transform(F.filter(F.sequence(F.lit(0), n - span), lambda j: F.array_min(F.slice(same, j + 1, span)) == 1), lambda j: F.sequence(j + shift, j + shift + span - 1)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ratio: int = 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, item_ids and contaminated (n_hit > 0 and ratio * n_hit >=
    n_words), which replace columns of these names. item_ids: the items that occur, sorted as strings."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("item_words")).where(F.size("item_words") > 0)
    found = alignments(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), items, "_id").join(items, "item_id")
    found = found.groupBy("_id").agg(F.collect_list(F.struct("item_id", "item_words", "shifts")).alias("_found"))
    names = ("n_words", "n_hit", "n_items", "items_sha256", "item_ids", "contaminated")
    out = docs.drop(*names).join(found, F.col(id_col).eqNullSafe(F.col("_id")), "left").drop("_id")
    none = F.array().cast("array<struct<item_id:string,hits:array<int>>>")
    known = F.col("_found").isNotNull()

    def hits(ws: Column) -> Column:
        found_at = F.transform("_found", lambda f: F.struct(f["item_id"].cast("string").alias("item_id"), F.array_distinct(F.flatten(F.transform(f["shifts"], lambda s: _hits(ws, f["item_words"], s)))).alias("hits")))
        return F.when(known, F.filter(found_at, lambda x: F.size(x["hits"]) > 0)).otherwise(none)

    # One array element per row, exploded: the words are computed once, also where a filter on the result follows.
    text = F.when(known, words(F.col(text_col))).otherwise(words(F.col(text_col), exact=False))
    judged = F.transform(F.array(text), lambda ws: F.struct(F.size(ws).alias("n_words"), hits(ws).alias("hits")))
    out = out.select(*[c for c in out.columns if c != "_found"], F.explode(judged).alias("_r"))
    each = F.array_distinct(F.flatten(F.transform("_r.hits", lambda x: x["hits"])))
    out = out.withColumns({"n_words": F.col("_r.n_words").cast("long"), "n_hit": F.size(each).cast("long"), "item_ids": F.array_sort(F.array_distinct(F.transform("_r.hits", lambda x: x["item_id"])))})
    out = out.withColumns({"n_items": F.size("item_ids").cast("long"), "items_sha256": F.sha2(F.array_join("item_ids", ","), 256), "contaminated": (F.col("n_hit") > 0) & (ratio * F.col("n_hit") >= F.col("n_words"))})
    return out.drop("_r")

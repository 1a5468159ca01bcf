"""Benchmark decontamination with DataFrame operations only.

Texts are cut into words (runs of letters and digits, in lower case) and shingles of five words. For every place at which
a document holds a shingle of a benchmark item, the window of the item's size that starts there is fingerprinted by SimHash.
Fingerprints are cut into one block more than the search radius, so two fingerprints within the radius agree on a block
at least: equal blocks of windows and items of the same size are joined, where the item holds the window's first shingle;
the Hamming distance is checked, and the weighted Jaccard similarity of the shingles (weight: number of occurrences) of what is left is computed exactly.

Only windows that start with a shingle of an item are needed: moving a window to the right until its first shingle is the
item's never lowers the similarity. Windows with the same shingles are compared once, whatever the number of documents
that hold them.

Items of fewer than five words have no shingle and match nothing; so do null and empty texts. Rows with a null id can't be
named in the report and are left out of it; ``decontaminate`` judges each by its text. Repeated rows and rows of one id count as one document, which holds an item if one
of its texts does; the same holds for items. Extra columns are left out; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.llm.common import materialize

SHINGLE, SIMILARITY = 5, 0.8

#: At similarity 0.8 fingerprints differ in 10 of 64 bits on average, with a standard deviation of 3.
RADIUS = 20

#: Shingles of all items up to which they are sent to every executor (16 bytes each); beyond, they are joined by shuffle.
MOST_SENT = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``size`` (words) and ``s``, the shingles' hashes in order, null where a text has too few words.

    Don't filter on ``s`` before it is written or exploded: a filter would be pushed below the words and cut the text
    again for every shingle. For the same reason callers explode with an outer generator.
    """
    hashed = df.select(*keep, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("w"))
    each = F.transform(
        F.sequence(F.lit(0), F.size("w") - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(SHINGLE)]))
    return hashed.select(*keep, F.size("w").alias("size"), F.when(F.size("w") >= SHINGLE, each).alias("s"))


def fingerprint(s: Column) -> Column:
    """SimHash: bit b is set if more than half of the shingles have it set."""
    majority = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: (2 * F.aggregate(s, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int")) > F.size(s)).cast("int"))
    return F.conv(F.array_join(majority, ""), 2, 16)


def bits(code: Column) -> Column:
    """The fingerprint as 64 characters."""
    return F.lpad(F.conv(code, 16, 2), 64, "0")


def blocks(code: Column) -> Column:
    """RADIUS + 1 blocks as (number, bits)."""
    edges = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return F.array(*[
        F.struct(F.lit(k).alias("number"), F.substring(bits(code), a + 1, b - a).alias("value"))
        for k, (a, b) in enumerate(zip(edges, edges[1:]))])


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    half = lambda c, at: F.conv(F.substring(F.lpad(c, 16, "0"), at, 8), 16, 10).cast("long")
    return sum((F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 9)), F.lit(0))


def tagged(s: Column) -> Column:
    """Shingles made different by their occurrence: a set in place of a bag."""
    ordered = F.array_sort(s)
    return F.transform(ordered, lambda h, i: F.xxhash64(h, (i - F.array_position(ordered, h)).cast("int")))


def contamination(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): the best window of every document for every item that it holds."""
    named = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    items = materialize(shingles(named, ["item_id"]), "items").filter(F.col("s").isNotNull())
    wanted = items.select(F.explode("s").alias("h"), "size").distinct().groupBy("h").agg(F.collect_set("size").alias("sizes"))
    if items.agg(F.coalesce(F.sum(F.size("s")), F.lit(0))).first()[0] <= MOST_SENT:
        wanted = F.broadcast(wanted)
    docs = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    places = shingles(docs, ["doc_id"]).select("doc_id", F.posexplode_outer("s").alias("at", "h")).join(wanted, "h").select(
        "doc_id", F.explode("sizes").alias("size"), "at")
    places = places.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("at", "size")).alias("places"))  # at most words x sizes
    places = materialize(places, "places")
    # The same plan at every size: few places would be broadcast, many not.
    held = shingles(docs.join(places.hint("merge"), "doc_id"), ["doc_id", "places"]).select("doc_id", "s", F.explode_outer("places").alias("p"))
    held = held.filter(F.col("p.at") < F.size("s")).select(
        "doc_id", F.col("p.at").alias("at"), F.col("p.size").alias("size"), F.slice("s", F.col("p.at") + 1, F.col("p.size") - SHINGLE + 1).alias("s"))
    windows = materialize(held.withColumns({"a": F.xxhash64("s"), "b": F.xxhash64(F.lit(1), "s")}), "windows")

    kinds = windows.groupBy("size", "a", "b").agg(F.first("s").alias("s"))
    kinds = materialize(kinds.withColumn("code", fingerprint(F.col("s"))), "kinds")
    coded = materialize(items.withColumn("code", fingerprint(F.col("s"))), "coded")
    # A window starts with a shingle of the item, so that shingle is part of the key: no block is shared by all windows of a size.
    left = kinds.select("size", "a", "b", F.get("s", F.lit(0)).alias("h"), F.col("code").alias("kind_code"), F.explode(blocks(F.col("code"))).alias("block"))
    right = coded.select("size", "item_id", F.xxhash64("s").alias("i"), F.explode(F.array_distinct("s")).alias("h"), F.col("code").alias("item_code"))
    right = right.select("*", F.explode(blocks(F.col("item_code"))).alias("block"))
    near = left.join(right, ["size", "h", "block"]).filter(distance(F.col("kind_code"), F.col("item_code")) <= RADIUS)
    near = near.select("size", "a", "b", "item_id", "i").distinct()

    pairs = near.join(kinds.select("size", "a", "b", "s"), ["size", "a", "b"]).join(
        coded.select("item_id", F.xxhash64("s").alias("i"), F.col("s").alias("t")), ["item_id", "i"])
    common = F.size(F.array_intersect(tagged(F.col("s")), tagged(F.col("t"))))
    pairs = pairs.select(
        "size", "a", "b", "item_id", (common / (F.size("s") + F.size("t") - common)).alias("similarity")).filter(F.col("similarity") >= similarity)
    found = windows.select("doc_id", "at", "size", "a", "b").join(pairs, ["size", "a", "b"])
    best = F.max(F.struct("similarity", (-F.col("at")).alias("at")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", (-F.col("best.at")).cast("long").alias("start_word"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. Rows of one id are one document; each text without an id is one."""
    body = F.coalesce(F.col("text"), F.lit(""))
    unnamed = F.concat(F.lit("n"), F.xxhash64(body).cast("string"), F.lit(":"), F.length(body).cast("string"))
    keyed = docs.withColumn("__document", F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), unnamed))
    held = contamination(keyed.select("__document", "text"), benchmark, doc_id="__document").select(F.col("doc_id").alias("__document")).distinct()
    return keyed.join(held, "__document", "left_anti").select(*docs.columns)

"""Operator 10, benchmark decontamination by size-partitioned MinHash
containment search. Native: only DataFrame functions.

An item (a short test text) is contained in a document when at least the share
``threshold`` of its distinct word shingles occurs there. Items are partitioned
by size; a partition with at most u shingles per item keeps, of each item, the
``u - ceil(threshold * u) + 1`` smallest shingle hashes (a bottom-k MinHash
sketch). A document that contains the item lacks at most the other
``u - ceil(threshold * u)``, so at least one sketch value is among its own
shingle hashes: the search loses nothing, unlike banded signatures of whole
documents, whose Jaccard similarity with a short item is near 0. Candidates are
verified on all shingles of the item.

Items shorter than the shingle are one shingle of all their words, looked for
among windows of that many words.

The item side is broadcast only when counted to be within ``BROADCAST_ROWS``
rows; a larger one is joined through a shuffle.

Defined cases: NULL or empty texts have no shingles and match nothing; repeated
rows (equal id and text) are one document; a NULL id is kept as NULL; items
that repeat count each; other columns are not read; an empty table on either
side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipscope.llm.base import HASH, ID, SPACE, join_key, keyed, lower_ascii, maybe_broadcast, stored

K, THRESHOLD = 5, 75
BROADCAST_ROWS = 1_000_000
BLANK = " \t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words."""
    t = F.btrim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(BLANK))
    return F.when(t == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(t, f"{SPACE}+"), lambda w: F.xxhash64(w)))


def window_hashes(words: Column, k: int) -> Column:
    """Hashes of all ``k``-word windows; none where there are fewer words."""
    if k == 1:
        return words
    return F.when(F.size(words) >= k, F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)])))


def item_shingles(items: DataFrame, id_col="item_id", text_col="text", k=K) -> DataFrame:
    """(item, item_id, k, n, shingle): every distinct shingle of each item;
    ``k`` is the window's words, ``n`` the item's shingles."""
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), F.monotonically_increasing_id().alias("item"),
                        word_hashes(F.col(f"`{text_col}`")).alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(k)))
    s = F.array(*[F.lit(None).cast("array<bigint>")])
    by_k = F.coalesce(*[F.when(F.col("k") == j, window_hashes(F.col("w"), j)) for j in range(1, k + 1)], s[0])
    rows = rows.withColumn("s", F.array_sort(F.array_distinct(by_k)))
    return stored(rows.select("item", "item_id", "k", F.size("s").alias("n"), F.posexplode("s").alias("rank", "shingle")),
                  "item-shingles")


def sketch(shingles: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """The sketch values of each item, its size partition's share of them. The
    partition's upper bound is the next power of two."""
    upper = F.pow(2, F.ceil(F.log2(F.col("n").cast("double")))).cast("long")
    keep = upper - F.ceil(upper * threshold / 100) + 1
    return shingles.where(F.col("rank") < keep).select("item", "k", "shingle")


def _probe(docs: DataFrame, side: DataFrame, lengths: list[int]) -> DataFrame:
    """Join the documents' window hashes, exploded, with ``side``."""
    side = side.withColumnsRenamed({"shingle": "__s", "k": "__k"})
    words = docs.select(*[c for c in docs.columns if c != "__text"], word_hashes(F.col("__text")).alias("__w"))
    out = None
    for k in lengths:
        one = words.withColumn("__h", F.explode(window_hashes(F.col("__w"), k))).drop("__w")
        hit = one.join(side.where(F.col("__k") == k), F.col("__h") == F.col("__s")).drop("__s", "__k")
        out = hit if out is None else out.unionAll(hit)
    return out


def contained(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id_col="item_id",
              item_text_col="text", k=K, threshold=THRESHOLD) -> DataFrame:
    """One row per document and item it contains: the row key, item_id,
    n_item, n_shared and containment."""
    spark = docs.sparkSession
    shingles = item_shingles(items, item_id_col, item_text_col, k)
    lengths = sorted(r[0] for r in shingles.select("k").distinct().collect())  # at most k values
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias(ID), F.xxhash64(F.col(f"`{text_col}`")).alias(HASH),
                       F.col(f"`{text_col}`").alias("__text"))
    if not lengths:
        kind = items.schema[item_id_col].dataType.simpleString()
        return spark.createDataFrame([], f"__llm_id long, __llm_hash long, item_id {kind}, n_item int, n_shared long, containment double")
    side = maybe_broadcast(stored(sketch(shingles, threshold), "item-sketches"), BROADCAST_ROWS)
    pairs = stored(_probe(rows, side, lengths).select(ID, HASH, "item").distinct(), "contained-candidates")
    whole = rows.join(maybe_broadcast(_key(pairs.select(ID, HASH).distinct()), BROADCAST_ROWS),
                      F.col(ID).eqNullSafe(F.col("__c_id")) & (F.col(HASH) == F.col("__c_hash")), "left_semi")
    full = maybe_broadcast(shingles.select("item", "k", "shingle"), BROADCAST_ROWS)
    shared = (_probe(whole, full, lengths).distinct().groupBy(ID, HASH, "item").agg(F.count("*").alias("n_shared")))
    size = shingles.where("rank = 0").select("item", "item_id", F.col("n").alias("n_item"))
    return (shared.join(size, "item").where(F.col("n_shared") * 100 >= F.col("n_item") * threshold)
            .select(ID, HASH, "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")))


def _key(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({ID: "__c_id", HASH: "__c_hash"})


def clean(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns."""
    found = stored(contained(docs, items, id_col, text_col, **options).select(ID, HASH).distinct(), "contaminated")
    d = keyed(docs, id_col, text_col).withColumn(ID, F.col(ID).cast("long"))
    return join_key(d, maybe_broadcast(found, BROADCAST_ROWS), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

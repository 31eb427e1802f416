"""The chunk store of the retrieval flow, kept across runs (sink_chunk_store).

The store is a versioned table keyed by the fingerprint of the documents' files
and of the parameters. When these change, chunks (and vectors) of documents whose
text is as before are taken from the previous version, and only the others are
cut and embedded; chunk ids are a sequence over the whole store and are numbered
anew. ``force_rebuild`` takes nothing from before.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.functions import text as tx
from tipscope.operators.ranges import prefix_offsets
from tipscope.sources import files
from tipscope.sources.versions import VersionedTable, fingerprint


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Documents with the hash that tells whether one is as before."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                    F.col(f"`{text_col}`").alias("_text"))
    same = F.sha2(F.concat_ws("|", F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(-1)), F.col("source").cast("string"),
                              F.coalesce(F.length("_text"), F.lit(-1)), "_text"), 256)
    return d.withColumn("doc_hash", same)


def build(docs: DataFrame, before: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None,
          id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          size: int = tx.CHUNK_SIZE, overlap: int = tx.CHUNK_OVERLAP) -> DataFrame:
    """(chunk_id, doc_id, source, chunk, doc_hash, pos and what ``embed`` adds),
    reusing the chunks of ``before``."""
    d = _keyed(docs, id_col, source_col, text_col)
    # documents that are equal in id, source and text have equal chunks: one stands for all, with their number
    one = d.groupBy("doc_id", "doc_hash").agg(F.count(F.lit(1)).alias("_copies"), F.first("source").alias("source"),
                                              F.first("_text").alias("_text"))

    def cut(x: DataFrame) -> DataFrame:
        t = x.withColumn("_t", tx.squish(F.coalesce("_text", F.lit(""))))
        c = t.select("doc_id", "doc_hash", "source", F.posexplode(tx.chunks("_t", size, overlap)).alias("pos", "chunk"))
        return embed(c) if embed else c

    if before is None:
        chunks = cut(one)
    else:
        old = before.drop("chunk_id").dropDuplicates(["doc_id", "doc_hash", "pos"])
        known = old.where("pos = 0").select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash"))
        same = (F.col("doc_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        new = cut(one.join(known, same, "left_anti"))
        now = one.select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash"))
        chunks = new.unionByName(old.join(now, same, "left_semi").select(*new.columns))
    chunks = files.stored(chunks, "chunks")
    counts = chunks.groupBy("doc_id", "doc_hash").agg(F.count(F.lit(1)).alias("_n"))
    copies = one.select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash"), "_copies")
    same = (F.col("doc_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    counts = counts.join(copies, same).select("doc_id", "doc_hash", "_n", "_copies", (F.col("_n") * F.col("_copies")).alias("_all"))
    o = prefix_offsets(counts, ["doc_id", "doc_hash"], "_all").withColumnsRenamed({"doc_id": "_id", "doc_hash": "_hash"})
    numbered = chunks.join(o.drop("_all"), same).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    at = F.col("_offset") + F.col("_c") * F.col("_n") + F.col("pos") + 1
    return numbered.withColumn("chunk_id", at.cast("long")).select("chunk_id", *chunks.columns)


def chunk_table(docs: DataFrame, root: str, force_rebuild: bool = False, embed=None, **options) -> DataFrame:
    """The store of ``docs`` under ``root``: the current version if nothing has
    changed, else a new one."""
    t = VersionedTable(docs.sparkSession, root)
    mark = fingerprint(docs, sorted(options.items()), getattr(embed, "__qualname__", embed))
    return t.get(mark, lambda before: build(docs, before, embed, **options), force_rebuild)

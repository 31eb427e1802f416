"""Operator 9, quality rules with cross-document line frequency.

Base rules: a document fails with fewer than 50 words, or with more than half
of its words inside three-word windows that it repeats. Method: lines are
normalised (A-Z lower-cased, digits made 0, white space runs made one space)
and hashed; per host the distinct documents of each line are counted. A line
is above the limit when more than ``max(min_docs, max_share * documents of the
host)`` documents hold it. Such lines are removed from every document but the
host's first holder (smallest id), and a document is rejected as depleted when
less than ``min_left`` of its words are left.

Defined cases: a NULL or empty text has no words and fails the base rules; a
NULL host is a host of its own; rows are documents, so repeated rows count
apart but get equal verdicts (a repeated first holder keeps its lines in each
row). Lines without a word are neither counted nor removed. Other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm.base import HASH, ID, join_key, keyed, ship, sliced, stored
from tipscope.llm.tokens import Words

ship(__name__)

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Limits of the line rule.
MIN_DOCS, MAX_SHARE, MIN_LEFT = 3, 0.01, 0.5
NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"abcdefghijklmnopqrstuvwxyz0000000000")
LINE = "array<struct<h:bigint,w:int>>"
FIELDS = ("id long, text_hash long, host string, n_words long, word_chars long, n_symbols long, "
          f"n_dup_lines long, n_repeat_words long, lines {LINE}")


def line_key(words: list[bytes]) -> int:
    """Hash of a line's normalised words."""
    return int.from_bytes(hashlib.blake2b(b" ".join(words).translate(NORMAL), digest_size=8).digest(),
                          "little", signed=True)


def split_line(line: bytes) -> list[bytes]:
    """Words of one line; bytes.split takes the same six characters as space."""
    return line.split()


def repeated_words(h) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(h) < 4:
        return 0
    w = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    _, inverse, times = np.unique(w, return_inverse=True, return_counts=True)
    hit = (times > 1)[inverse]
    cover = np.zeros(len(h), bool)
    for j in range(3):
        cover[j:len(w) + j] |= hit
    return int(cover.sum())


def _measures(batches):
    """Base counts and the lines of each document."""
    words = Words()
    mark = bytes(i for i in range(256) if i not in SYMBOLS)
    gap_or_inner = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])
    for b in batches:
        texts = b.column(1).to_pylist()
        hashes, counts = words.hashes(texts, fold=False)
        at, rows = 0, [[] for _ in range(5)]
        lines = []
        for t, n in zip(texts, counts):
            data = (t or "").encode("utf-8", "surrogatepass")
            seen, own, dup = set(), {}, 0
            for line in data.split(b"\n"):
                if w := split_line(line):
                    dup += line in seen
                    seen.add(line)
                    k = line_key(w)
                    own[k] = own.get(k, 0) + len(w)
            for r, x in zip(rows, (int(n), len(data.translate(None, gap_or_inner)),
                                   len(data.translate(None, mark)), dup, repeated_words(hashes[at:at + n]))):
                r.append(x)
            lines.append([{"h": k, "w": w} for k, w in own.items()])
            at += n
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), b.column(3), *(pa.array(r, pa.int64()) for r in rows),
             pa.array(lines, pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())])))],
            names=["id", "text_hash", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                   "n_repeat_words", "lines"])


def measure(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """Base counts, stored, with a row number ``rid``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
                       F.col(f"`{host_col}`").cast("string").alias("host"))
    m = rows.mapInArrow(sliced(_measures), FIELDS).withColumn("rid", F.monotonically_increasing_id())
    return stored(m, "line-measures")


def frequent_lines(m: DataFrame, min_docs=MIN_DOCS, max_share=MAX_SHARE) -> DataFrame:
    """(host, h, first): lines above their host's limit and the smallest id
    that holds them. Lines are distinct within a row, so rows are counted."""
    size = m.groupBy("host").agg(F.count("*").alias("docs"))
    held = (m.select("host", "id", F.explode("lines").alias("l")).groupBy("host", F.col("l.h").alias("h"))
            .agg(F.count("*").alias("df"), F.min("id").alias("first")).where(F.col("df") > min_docs))
    s = size.withColumnRenamed("host", "s_host")
    return (held.join(F.broadcast(s) if s.limit(100_001).count() <= 100_000 else s,
                      F.col("host").eqNullSafe(F.col("s_host")))
            .where(F.col("df") > F.col("docs") * max_share).select("host", "h", "first"))


def verdicts(m: DataFrame, min_docs=MIN_DOCS, max_share=MAX_SHARE, min_left=MIN_LEFT) -> DataFrame:
    """Base counts with base_failed, n_removed_words, kept and the hashes of
    the lines that are removed (``drop``)."""
    often = stored(frequent_lines(m, min_docs, max_share), "frequent-lines").select(
        F.col("host").alias("f_host"), F.col("h").alias("f_h"), "first")
    if often.limit(1_000_001).count() <= 1_000_000:
        often = F.broadcast(often)
    lost = (m.select("rid", "id", "host", F.explode("lines").alias("l"))
            .join(often, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("l.h") == F.col("f_h")))
            .where(~F.col("id").eqNullSafe(F.col("first")))
            .groupBy("rid").agg(F.sum("l.w").cast("long").alias("n_removed_words"),
                                F.sort_array(F.collect_list("l.h")).alias("drop")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = m.drop("lines").join(lost, "rid", "left").withColumn("base_failed", failed).withColumn(
        "n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & left)


def quality_report(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", **limits) -> DataFrame:
    """One row per input row: id, text_hash, host, the base counts,
    base_failed, n_removed_words and kept."""
    return verdicts(measure(docs, id_col, text_col, host_col), **limits).drop("rid", "drop")


def _strip(columns, text_at, drop_at):
    """Remove the listed lines from the texts; the line breaks of the others stay."""
    def run(batches):
        for b in batches:
            texts = []
            for t, drop in zip(b.column(text_at).to_pylist(), b.column(drop_at).to_pylist()):
                if t and drop:
                    drop = set(drop)
                    t = "\n".join(x for x in t.split("\n")
                                  if not (w := split_line(x.encode("utf-8", "surrogatepass"))) or line_key(w) not in drop)
                texts.append(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if i == text_at else b.column(i) for i in range(len(columns))],
                names=columns)
    return run


def clean(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", **limits) -> DataFrame:
    """The kept rows of ``docs``, all columns, without the lines above their
    host's limit."""
    v = verdicts(measure(docs, id_col, text_col, host_col), **limits)
    v = (v.select(F.col("id").alias(ID), F.col("text_hash").alias(HASH), F.col("host").alias("__v_host"), "kept", "drop")
         .groupBy(ID, HASH, "__v_host").agg(F.first("kept").alias("__kept"), F.first("drop").alias("__drop")))
    d = keyed(docs, id_col, text_col).withColumn(ID, F.col(ID).cast("long"))
    r = v.withColumnsRenamed({ID: "__r_id", HASH: "__r_hash"})
    on = (d[ID].eqNullSafe(r["__r_id"]) & (d[HASH] == r["__r_hash"])
          & d[host_col].cast("string").eqNullSafe(r["__v_host"]))
    kept = d.join(r, on).where("__kept").select(*[d[c] for c in docs.columns], "__drop")
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    return kept.mapInArrow(sliced(_strip(docs.columns, at, len(docs.columns))), docs.schema)

"""Operator 2, line deduplication by pairwise alignment.

1. Lines are hashed; a line's holders are counted and its first holder found
   (smallest id, NULL last, then text hash). The same is done for windows: the
   shortest runs of lines from each line on, and up to each line, that reach
   ``min_words`` words. What one document holds is of no interest.
2. Every document is paired with the first holder of each line and window it
   shares: a line held by a thousand documents makes a thousand pairs, not half a
   million. Each line of a common block stands in one of the block's windows, so
   whatever block a document shares with any earlier one, all its lines are
   compared with a document that has them in such a run.
3. A pair is aligned by patience diff: lines unique in both are matched, a
   longest increasing subsequence of them anchors the alignment, equal lines
   next to anchors extend it, and the gaps are aligned the same way. Equal
   lines that the alignment leaves over (repeated in either text, or in another
   order) are matched too and extended to runs, so that the longest run of lines
   of the later text that the earlier one holds is found at every place.
4. Runs of matched lines of at least ``min_words`` words are common blocks; they
   are deleted from the later document of the pair, every copy of them. The
   first holder of a line never loses it, so one copy of each stays.

Defined cases: a NULL or empty text has no lines; repeated rows (equal id and
text) are one document with one result; a document of which nothing with a word
is left is not kept; blank lines match only next to other matches and are
deleted with their block; other columns are carried through; an empty table
gives an empty result.
"""

from __future__ import annotations

import array
import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipscope.llm.base import HASH, ID, join_key, keyed, ship, sliced, stored

ship(__name__)

#: Least words of a common block that is deleted.
MIN_WORDS = 30
BROADCAST_ROWS = 200_000


def line_hashes(text):
    """(hash, words) of each line; a line without a word has hash 0."""
    h, n = [], []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        w = line.split()
        n.append(len(w))
        h.append(int.from_bytes(hashlib.blake2b(b" ".join(w), digest_size=8).digest(), "little", signed=True) if w else 0)
    return h, n


def window_keys(h, n, min_words):
    """Hashes of the shortest runs of two or more lines that reach ``min_words``
    words, from each line on and up to each line; blank lines lie inside only."""
    at = [i for i, k in enumerate(n) if k]
    total = [0]
    for i in at:
        total.append(total[-1] + n[i])
    spans = set()
    for p in range(len(at)):
        if (q := bisect.bisect_left(total, total[p] + min_words, p + 1)) < len(total):
            spans.add((at[p], at[q - 1]))
        if (q := bisect.bisect_right(total, total[p + 1] - min_words, 0, p + 1)) > 0:
            spans.add((at[q - 1], at[p]))
    return sorted({int.from_bytes(hashlib.blake2b(array.array("q", h[i:j + 1]).tobytes(), digest_size=8).digest(),
                                  "little", signed=True) for i, j in spans if i < j})


def _lines(min_words):
    def run(batches):
        for b in batches:
            rows = [line_hashes(t) if t else ([], []) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                 pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                 pa.array([window_keys(*r, min_words) for r in rows], pa.list_(pa.int64()))],
                names=[ID, HASH, "lines", "words", "windows"])
    return run


def patience(a, b):
    """Matched places (i, j) of two lists, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:  # equal heads and tails
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        seen = {}
        for i in range(i0, i1):
            seen[a[i]] = -1 if a[i] in seen else i
        there = {}
        for j in range(j0, j1):
            if a_at := seen.get(b[j], -1) + 1:
                there[b[j]] = None if b[j] in there else (a_at - 1, j)
        unique = sorted((m for m in there.values() if m), key=lambda m: m[1])
        piles, back = [], []  # longest run of unique matches that increases in both
        tops = []
        for n, (i, _) in enumerate(unique):
            p = bisect.bisect_left(tops, i)
            back.append(piles[p - 1] if p else -1)
            if p == len(tops):
                tops.append(i)
                piles.append(n)
            else:
                tops[p], piles[p] = i, n
        chain, n = [], piles[-1] if piles else -1
        while n >= 0:
            chain.append(unique[n])
            n = back[n]
        chain.reverse()
        if not chain:
            continue
        i, j = i0, j0
        for x, y in chain:
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, i1, j, j1))
    return sorted(out)


def stretches(lines, held):
    """(start, end) of the longest stretches of lines that are all in ``held``."""
    start = None
    for i, x in enumerate([*lines, None]):
        if x in held:
            start = i if start is None else start
        elif start is not None:
            yield start, i
            start = None


def run_finder(a):
    """A function that gives, for a list of lines, the length of the longest run
    ending at each place that ``a`` holds: a suffix automaton of ``a``, built and
    read in linear time however often a line is repeated."""
    step, link, length, last = [{}], [-1], [0], 0
    for x in a:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if length[q] > length[p] + 1:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new

    def find(lines):
        out, at, n = [], 0, 0
        for x in lines:
            while at and x not in step[at]:
                at = link[at]
                n = length[at]
            if x in step[at]:
                at, n = step[at][x], n + 1
            out.append(n)
        return out
    return find


def left_over_blocks(a, b, words, min_words, gone):
    """Places in ``b``, not in ``gone``, of runs that ``a`` holds anywhere, with at
    least ``min_words`` words; a run may reach over places that are gone."""
    held, gone, out, find = set(a), set(gone), [], None
    for start, end in stretches(b, held):
        places = range(start, end)
        if sum(words[start:end]) < min_words or all(j in gone or not words[j] for j in places):
            continue
        if find is None:
            mine, parts = set(b), []
            for i0, i1 in stretches(a, mine):
                parts += [*a[i0:i1], None]  # no line equals None, so no run crosses it
            find = run_finder(parts)
        total = [0]
        for j in places:
            total.append(total[-1] + words[j])
        free = end  # the first place that a later run has covered
        for j, n in reversed([*zip(places, find(b[start:end]))]):
            first = j - n + 1
            if first < free and total[j - start + 1] - total[first - start] >= min_words:
                out += [k for k in range(first, min(j + 1, free)) if k not in gone]
                free = first
    return out


def common_blocks(a, b, words, min_words):
    """Places in ``b`` of aligned or left-over runs with at least ``min_words`` words."""
    gone, run = [], []
    for i, j in [*patience(a, b), (-2, -2)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[y] for _, y in run) >= min_words:
                gone += [y for _, y in run]
            run = []
        run.append((i, j))
    return sorted(gone + left_over_blocks(a, b, words, min_words, gone))


def _aligned(min_words):
    def run(batches):
        for b in batches:
            mine, words, other = (b.column(i).to_pylist() for i in (2, 3, 4))
            gone = [common_blocks(o, m, w, min_words) for m, w, o in zip(mine, words, other)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(gone, pa.list_(pa.int32()))], names=[ID, HASH, "gone"])
    return run


def deletions(docs: DataFrame, id_col="doc_id", text_col="text", min_words=MIN_WORDS) -> DataFrame:
    """(row key, gone): the places of the lines to delete, for documents that
    lose any."""
    rows = keyed(docs, id_col, text_col).select(F.col(ID).cast("long").alias(ID), HASH, F.col(f"`{text_col}`").alias("text"))
    lines = rows.mapInArrow(sliced(_lines(min_words)), f"{ID} long, {HASH} long, lines array<bigint>, words array<int>, "
                            "windows array<bigint>")
    lines = stored(lines.dropDuplicates([ID, HASH]).withColumn(
        "doc", F.struct(F.col(ID).isNull().alias("no_id"), F.col(ID).alias("i"), F.col(HASH).alias("h"))), "document-lines")
    held = lines.select("doc", F.explode(F.array_distinct(F.concat("lines", "windows"))).alias("key")).where("key <> 0")
    shared = held.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("holders")).where("holders > 1")
    pairs = held.join(shared, "key").where("doc <> first").select("doc", "first").distinct()
    mine = lines.select("doc", ID, HASH, "lines", "words")
    other = lines.select(F.col("doc").alias("first"), F.col("lines").alias("others"))
    gone = (pairs.join(mine, "doc").join(other, "first").select(ID, HASH, "lines", "words", "others")
            .mapInArrow(_aligned(min_words), f"{ID} long, {HASH} long, gone array<int>").where(F.size("gone") > 0))
    return stored(gone.groupBy(ID, HASH).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")), "line-deletions")


def _strip(names, text_at):
    """Delete the listed lines; add the counts of lines before and words left."""
    def run(batches):
        for b in batches:
            texts, n_lines, left = [], [], []
            for t, gone in zip(b.column(text_at).to_pylist(), b.column(len(names)).to_pylist()):
                lines = t.split("\n") if t else []
                gone = set(gone or ())
                keep = [x for i, x in enumerate(lines) if i not in gone]
                texts.append("\n".join(keep) if gone else t)
                n_lines.append(len(lines))
                left.append(sum(len(x.encode("utf-8", "surrogatepass").split()) for x in keep))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(texts, pa.string()) if i == text_at else b.column(i) for i in range(len(names))],
                 b.column(len(names)), pa.array(n_lines, pa.int64()), pa.array(left, pa.int64())],
                names=[*names, "__gone", "__lines", "__left"])
    return run


def stripped(docs: DataFrame, id_col="doc_id", text_col="text", min_words=MIN_WORDS) -> DataFrame:
    """``docs`` with shortened texts and the columns __gone (places of deleted
    lines), __lines (lines before) and __left (words left)."""
    found = deletions(docs, id_col, text_col, min_words).withColumnRenamed("gone", "__gone")
    small = found.agg(F.sum(F.size("__gone") + 4)).first()[0] or 0
    if small <= BROADCAST_ROWS * 8:
        found = F.broadcast(found)
    d = keyed(docs, id_col, text_col).withColumn(ID, F.col(ID).cast("long"))
    d = join_key(d, found, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__gone")
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    schema = T.StructType([*docs.schema.fields, T.StructField("__gone", T.ArrayType(T.IntegerType())),
                           T.StructField("__lines", T.LongType()), T.StructField("__left", T.LongType())])
    return d.mapInArrow(sliced(_strip(docs.columns, at)), schema)


def clean(docs: DataFrame, id_col="doc_id", text_col="text", min_words=MIN_WORDS) -> DataFrame:
    """``docs``, all columns, without common blocks in the later documents;
    documents that lost their last word go."""
    s = stripped(docs, id_col, text_col, min_words).where((F.col("__left") > 0) | F.col("__gone").isNull())
    return s.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, id_col="doc_id", text_col="text", min_words=MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_lines, removed (places), n_words_left,
    kept and the text that is left."""
    s = stripped(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
                 min_words=min_words)
    return s.select("doc_id", F.col("__lines").alias("n_lines"), F.coalesce("__gone", F.array().cast("array<int>")).alias("removed"),
                    F.col("__left").alias("n_words_left"), ((F.col("__left") > 0) | F.col("__gone").isNull()).alias("kept"), "text")

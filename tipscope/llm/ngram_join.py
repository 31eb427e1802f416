"""Operator 6, n-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles; two documents link when the
Jaccard similarity of their sets reaches the threshold. Steps:

1. Equal sets form one class, found by a hash of the set.
2. A shingle that only one class holds cannot be in an intersection. Shingles
   are counted in hash buckets; a class of which too few shingles are held by
   another class too can have no link and is done.
3. The other classes get a parity sketch per size band: shingles are dealt into
   the band's pieces, and a piece's word is the XOR of the hashes in it. One
   shingle of the symmetric difference changes at most one word, so the number
   of differing words (their Hamming distance) is a lower bound of the
   symmetric difference. At the threshold this is at most ``d``; so of the
   first ``d + 1`` non-empty words of either set, in one fixed order, at least
   one is common (pigeonhole). The order is by the number of classes that hold
   a word's shingles, the rarest first, so passages that very many share come
   last. Classes are joined on these words; of words that the same classes
   have, one is kept.
4. A second, 1024-bit parity sketch rejects candidate pairs whose Hamming
   distance is over ``d``; the others are verified on the whole sets.
5. Pairs are not expanded within a group that shares a word: its members are
   compared with one of them, drawn by hash, in a few rounds, and those already
   in its component are left out. Only members of groups that then still span
   several components are compared across these, in cells of members, the nearest
   first; cells of one component are not compared with each other. Members of
   several large groups are compared in the largest of these alone. Two cells of
   a large group give at most one candidate a member: where they have more, their
   whole sets are sent to one task, which gives the links that join components.

Defined cases: a NULL or empty text, or one without words, has no shingles and
is linked with nothing (its component is its own id). Fewer words than the
window make one shingle. Repeated rows and equal texts share a class. A NULL id
is ignored as a component's name where any member has an id. Other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm.base import ship, sliced, stored
from tipscope.llm.components import components
from tipscope.llm.tokens import Words, mix, windows

ship(__name__)

#: Shingles of one request block (more where there are many buckets, up to MOST)
#: and of one bucket's group, about.
BLOCK, MOST, GROUP = 1 << 19, 1 << 22, 1 << 20
#: Sets smaller than this have every shingle as a piece of its own.
SMALL = 256
SKETCH_BITS = 1024
#: Rounds in which the members of a group are compared with one of them.
HUB_ROUNDS = 2
#: Members of one cell of a group that shares a word, about; groups of more are large.
CELL = 256
#: Large groups that a member is known by: its largest. Fewer only repeat candidates.
LARGEST = 64
#: Shingles of one part of a cell whose whole sets are sent, about.
PART = 1 << 19
#: Stands for the number of a group that is not large.
LAST = (1 << 63) - 1


def trim():
    """Give back what the allocators keep of freed memory: workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """``run``, with freed memory given back after each batch that it yields and at
    its end."""
    def go(batches):
        for b in run(batches):
            yield b
            trim()
        trim()
    return go


def _sets(text_list, words, k):
    """The sorted distinct shingle hashes of each text."""
    h, n = words.hashes(text_list)
    at = 0
    for c in n:
        yield np.unique(windows(h[at:at + c], k))
        at += c


def _profiles(k):
    """id, size and hash of each document's set."""
    def run(batches):
        words = Words()
        for b in batches:
            size, key = [], []
            for s in _sets(b.column(1).to_pylist(), words, k):
                size.append(len(s))
                key.append(int(mix(s + np.uint64(7)).sum(dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(key, pa.int64())],
                names=["id", "text_hash", "n", "cls"])
    return run


def _requests(k, buckets):
    """Blocks of documents' shingle hashes by bucket: (bucket, block, low halves
    of the hashes that one document of the block holds, low halves of those that
    several hold, gaps between the numbers of the former's documents, their
    number of hashes). A hash that several hold is known to be shared, so it is
    sent once and asks for nothing: a shingle of very many documents is one
    value a block. The block's own row has its documents' classes, set sizes and
    numbers of hashes known to be shared."""
    def run(batches):
        words = Words()
        sets, total = [], 0

        def parts(values):
            """The places of each bucket's values, for the buckets that have any."""
            bucket = ((values >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            found, start = np.unique(bucket[order], return_index=True)
            return dict(zip(found.tolist(), np.split(order, start[1:]))) if len(found) else {}

        def flush():
            cls = np.array([mix(s + np.uint64(7)).sum(dtype=np.uint64) for s in sets], np.uint64)
            size = np.array([len(s) for s in sets], np.uint32)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), size)
            keys = mix(np.concatenate(sets) ^ np.uint64(0x5BD1E995))
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
            alone = first & np.concatenate((first[1:], [True]))
            known = np.bincount(owner[order[~alone]], minlength=len(sets)).astype(np.uint32)
            several = ordered[first & ~alone]
            one = np.sort(order[alone])
            keys, owner = keys[one], owner[one]
            block = int(mix(cls + np.arange(len(cls), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))
            at1, at2 = parts(keys), parts(several)
            none = np.zeros(0, np.int64)
            out = [(-1 - abs(block) % buckets, block, cls.tobytes(), b"", size.tobytes(), known.tobytes())]
            for x in sorted({*at1, *at2}):
                i, j = at1.get(x, none), at2.get(x, none)
                who, times = np.unique(owner[i], return_counts=True)
                out.append((x, block, keys[i].astype(np.uint32).tobytes(), several[j].astype(np.uint32).tobytes(),
                            np.diff(who, prepend=np.uint32(0)).tobytes(), times.astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in out], t) for j, t in
                 enumerate((pa.int32(), pa.int64(), *[pa.binary()] * 4))],
                names=["bucket", "block", "keys", "several", "gaps", "counts"])

        for b in batches:
            for s in _sets(b.column(0).to_pylist(), words, k):
                if len(s):
                    sets.append(s)
                    total += len(s)
                    if total >= max(BLOCK, min(64 * buckets, MOST)):
                        yield flush()
                        sets, total = [], 0
        if sets:
            yield flush()
    return run


def _held_elsewhere(group: pd.DataFrame) -> pd.DataFrame:
    """For each block's row of one bucket, the documents of which hashes occur in
    another block too, and how many."""
    if group.bucket.iloc[0] < 0:
        return group[["block"]].assign(cls=group["keys"], n=group["gaps"], owners=b"", held=group["counts"])
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in group["keys"]])
    every = np.concatenate([keys, *[np.frombuffer(x, np.uint32) for x in group["several"]]])
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    held = (twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys if len(twice)
            else np.zeros(len(keys), bool))
    block, owners, counts, at = [], [], [], 0
    for name, gaps, times in zip(group["block"], group["gaps"], group["counts"]):
        who = np.cumsum(np.frombuffer(gaps, np.uint32), dtype=np.uint32)
        times = np.frombuffer(times, np.uint32)
        ends = np.cumsum(times, dtype=np.int64)
        size = int(ends[-1]) if len(ends) else 0
        upto = np.concatenate(([0], np.cumsum(held[at:at + size])))
        got = (upto[ends] - upto[ends - times]).astype(np.uint32)
        at += size
        if got.any():
            block.append(name)
            owners.append(who[got > 0].tobytes())
            counts.append(got[got > 0].tobytes())
    del keys, held
    trim()
    return pd.DataFrame({"block": np.array(block, np.int64), "cls": b"", "n": b"",
                         "owners": np.array(owners, object), "held": np.array(counts, object)})


def _possible(share):
    """Of one block, the classes of which enough shingles occur elsewhere."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group["cls"].str.len() > 0
        base = group[own].iloc[0]
        held = np.frombuffer(base["held"], np.uint32).astype(np.int64)
        for who, got in zip(group.loc[~own, "owners"], group.loc[~own, "held"]):
            held[np.frombuffer(who, np.uint32)] += np.frombuffer(got, np.uint32)
        enough = 100 * held >= share * np.frombuffer(base["n"], np.uint32).astype(np.int64)
        return pd.DataFrame({"cls": np.frombuffer(base["cls"], np.int64)[enough]})
    return run


def _parity_bits(s):
    bit = (mix(s ^ np.uint64(0xA5A5A5A5)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(bit, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8))


def _whole_sets(k):
    """n, class, the sorted shingle hashes and the bit sketch of each text."""
    def run(batches):
        words = Words()
        for b in batches:
            sets = list(_sets(b.column(1).to_pylist(), words, k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([_parity_bits(s).tobytes() for s in sets], pa.binary())],
                names=["rep", "n", "items", "sketch"])
    return run


def band_floors(n, share):
    """The lower ends of the size bands up to ``n``: a set links only within
    its band and the next."""
    floors = [1]
    while floors[-1] <= n:
        floors.append(floors[-1] * 100 // share + 1)
    return floors


def sketch_words(s, rank, share):
    """(band, words) for the band that the set is in and the one below: the
    first ``d + 1`` words of its parity sketch there, the rarest first, without
    those that only this set has. ``rank``: of each shingle, how many sets hold
    it (1: this one alone). A word's rank is the least of its shingles' ranks, so
    sets with the same word give it the same place."""
    n = len(s)
    floors = band_floors(n, share)
    own = len(floors) - 2
    for band in (own, own - 1):
        if band < 0:
            continue
        # |A xor B| <= (|A|+|B|)(100-share)/(100+share) at the threshold
        other = n * 100 // share if band == own else floors[band + 1] - 1
        d = (n + other) * (100 - share) // (100 + share)
        if floors[band] < SMALL:
            word, held = mix(s + np.uint64(band + 1)), rank
        else:
            pieces = np.uint64(2 * floors[band])
            piece = mix(s + np.uint64(band + 1)) % pieces
            order = np.argsort(piece, kind="stable")
            piece = piece[order]
            first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            word = mix(np.bitwise_xor.reduceat(s[order], first) + mix(piece[first] + np.uint64(band + 1)))
            held = np.minimum.reduceat(rank[order], first)
        if len(word) <= d:
            raise ValueError(f"a sketch of {len(word)} words can't tell sets that differ in {d}")
        first = np.lexsort((word, held))[:d + 1]
        yield band, word[first[held[first] > 1]]


def _shingle_keys(items, buckets):
    """A block's distinct shingles as (bucket, key), in that order, and the place
    of each item's shingle among them."""
    keys, place = np.unique(mix(items ^ np.uint64(0x1B873593)), return_inverse=True)
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return bucket[order], keys[order].astype(np.uint32), back[place]


def _holders(buckets):
    """Blocks of sets: their distinct shingles by bucket, each once with the number
    of the block's sets that hold it, and the block's own row (bucket -1)."""
    def run(batches):
        names = ["bucket", "block", "keys", "counts", "reps", "sizes", "items"]
        reps, sets, total = [], [], 0

        def flush():
            items = np.concatenate(sets)
            bucket, keys, place = _shingle_keys(items, buckets)
            count = np.bincount(place, minlength=len(keys)).astype(np.uint32)
            found, start = np.unique(bucket, return_index=True)
            name = reps[0]  # a set is in one block
            out = [(-1, name, b"", b"", np.array(reps, np.int64).tobytes(), np.array([len(x) for x in sets], np.int64).tobytes(), items.tobytes())]
            out += [(int(x), name, k.tobytes(), c.tobytes(), b"", b"", b"") for x, k, c in
                    zip(found, np.split(keys, start[1:]), np.split(count, start[1:]))]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(
                (pa.int32(), pa.int64(), *[pa.binary()] * 5))], names=names)

        for b in batches:
            for rep, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(raw.as_py(), np.uint64)
                reps.append(rep)
                sets.append(x)
                total += len(x)
                if total >= max(BLOCK, min(64 * buckets, MOST)):
                    yield flush()
                    reps, sets, total = [], [], 0
        if sets:
            yield flush()
    return run


def _ranks(group: pd.DataFrame) -> pd.DataFrame:
    """For each block's row of one bucket, how many sets hold each key: the number
    up to 200, then steps of its logarithm."""
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in group["keys"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in group["counts"]])
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    held = np.add.reduceat(counts[order], start, dtype=np.int64)
    step = np.minimum(np.where(held <= 200, held, 200 + 2 * np.log2(np.maximum(held, 200) / 200)), 255).astype(np.uint8)
    rank = np.empty(len(keys), np.uint8)
    rank[order] = np.repeat(step, np.diff(np.append(start, len(keys))))
    del keys, counts, order, start, held
    trim()
    ends = np.cumsum([len(x) // 4 for x in group["keys"]])
    return pd.DataFrame({"bucket": group["bucket"], "block": group["block"], "reps": b"", "sizes": b"", "items": b"",
                         "ranks": [x.tobytes() for x in np.split(rank, ends[:-1])]})


def _rare_words(buckets, share):
    """Of one block, the words of its sets."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bucket")
        own = group.iloc[0]  # its bucket is -1
        items = np.frombuffer(own["items"], np.uint64)
        ranks = np.frombuffer(b"".join(group["ranks"].iloc[1:]), np.uint8)
        _, _, place = _shingle_keys(items, buckets)
        rank, at = ranks[place], 0
        rep, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r, n in zip(np.frombuffer(own["reps"], np.int64), np.frombuffer(own["sizes"], np.int64)):
            for _, words in sketch_words(items[at:at + n], rank[at:at + n], share):
                rep.append(np.full(len(words), r, np.int64))
                key.append(words.view(np.int64))
            at += n
        return pd.DataFrame({"rep": np.concatenate(rep), "key": np.concatenate(key)})
    return run


def _words(sets: DataFrame, share: int) -> DataFrame:
    """(rep, key): the rarest words of each class's sketches. Shingles are counted
    by bucket over blocks of classes, in which each is sent once, so one that most
    classes hold is one value a block."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // GROUP))
    asked = stored(sets.select("rep", "items").mapInArrow(
        trimmed(_holders(buckets)), "bucket int, block long, keys binary, counts binary, reps binary, sizes binary, items binary"), "holders")
    fields = "bucket int, block long, reps binary, sizes binary, items binary, ranks binary"
    told = (asked.where("bucket >= 0").select("bucket", "block", "keys", "counts").groupBy("bucket").applyInPandas(_ranks, fields)
            .unionByName(asked.where("bucket < 0").select("bucket", "block", "reps", "sizes", "items", F.lit(b"").alias("ranks"))))
    return told.groupBy("block").applyInPandas(_rare_words(buckets, share), "rep long, key long")


def _groups(words: DataFrame) -> DataFrame:
    """(key, rep) of the words that several classes have, one word for each set of
    classes: words of the same classes say the same. Sets are told apart by their
    number and two hashes, added up map-side."""
    g = words.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"),
                                 F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("n > 1")
    return words.join(g.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key").select("rep", "key")


def _near(share):
    """Keep pairs whose sizes and sketches allow a link."""
    def run(batches):
        ones = np.array([bin(i).count("1") for i in range(256)], np.uint16)
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = (np.array(b.column(i)) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                    for i in (4, 5))
            apart = ones[x ^ y].sum(axis=1)
            ok = apart <= (na + nb) * (100 - share) // (100 + share)
            ok &= 100 * np.minimum(na, nb) >= share * np.maximum(na, nb)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])
    return run


def _reaches(x, y, share):
    """Whether two sorted sets reach the threshold."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= share * (len(x) + len(y) - both)


def _linked(share):
    """Keep pairs whose whole sets reach the threshold."""
    def run(batches):
        for b in batches:
            ok = pa.array([_reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share)
                           for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])
    return run


def _members(m):
    """Of one list of members the ids, components, set sizes and sketches, and the
    places of members beside the large groups that hold them."""
    rep, comp, n = (m.field(k).to_numpy(zero_copy_only=False) for k in ("rep", "component", "n"))
    large = m.field("large")
    who = np.repeat(np.arange(len(rep)), large.value_lengths().to_numpy(zero_copy_only=False))
    return (rep, comp, n, np.frombuffer(b"".join(m.field("sketch").to_pylist()), np.uint8).reshape(len(rep), -1),
            who, large.flatten().to_numpy(zero_copy_only=False))


def _larger(one, two, number):
    """For each member of two cells of a group, bits of the groups before it that
    hold members of both cells: pairs with a common bit are compared there."""
    before = [(who[large < number], large[large < number]) for *_, who, large in (one, two)]
    both = np.intersect1d(before[0][1], before[1][1])
    out = []
    for cell, (who, large) in zip((one, two), before):
        has = np.zeros((len(cell[0]), len(both)), bool)
        if len(both):
            at = np.minimum(np.searchsorted(both, large), len(both) - 1)
            known = both[at] == large
            has[who[known], at[known]] = True
        out.append(np.packbits(has, axis=1))
    return out


def _close(one, two, own, number, share):
    """Places (i, j) of the pairs of two cells' members (``own``: of one cell's with
    each other) that lie in different components and whose sizes and sketches allow
    a link, the nearest first; without those that an earlier group has."""
    ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)
    (rep, comp, n, bits, *_), (rep2, comp2, n2, bits2, *_) = one, two
    larger, larger2 = _larger(one, two, number)
    found = [(np.zeros(0, np.int64),) * 3]
    for i in range(len(rep)):
        j = np.flatnonzero((comp2 != comp[i]) & (100 * np.minimum(n[i], n2) >= share * np.maximum(n[i], n2)))
        if own:
            j = j[rep2[j] < rep[i]]
        j = j[~(larger2[j] & larger[i]).any(axis=1)]
        apart = ones[bits2[j] ^ bits[i]].sum(axis=1, dtype=np.int64)
        near = apart <= (n2[j] + n[i]) * (100 - share) // (100 + share)
        found.append((np.full(int(near.sum()), i), j[near], apart[near]))
    i, j, apart = map(np.concatenate, zip(*found))
    order = np.argsort(apart, kind="stable")
    return i[order], j[order]


def _forest(x, y, holds=None):
    """Places of the pairs of components that are not joined by the pairs taken
    before them; ``holds``: whether the pair at a place may be taken."""
    up, taken = {}, []

    def top(c):
        while (d := up.get(c, c)) != c:
            up[c] = up.get(d, d)
            c = d
        return c
    for k, (p, q) in enumerate(zip(x.tolist(), y.tolist())):
        p, q = top(p), top(q)
        if p != q and (holds is None or holds(k)):
            up[p] = q
            taken.append(k)
    return np.array(taken, np.int64)


def _across(share, nearest):
    """Candidate pairs of two cells of a group (or of one cell with itself):
    ``nearest``: the nearest that join components; else all, or, if the group is
    large and they are more than the cells' members, only the number of the pair of
    cells. A pair is given once a batch."""
    def run(batches):
        for batch in batches:
            out, dense = [(np.zeros(0, np.int64),) * 2], []
            pair, own, number, x, y = batch.columns
            for row in range(batch.num_rows):
                one = _members(x[row].values)
                two = one if own[row].as_py() else _members(y[row].values)
                i, j = _close(one, two, own[row].as_py(), number[row].as_py(), share)
                if nearest:
                    first = _forest(one[1][i], two[1][j])
                    i, j = i[first], j[first]
                elif number[row].as_py() != LAST and len(i) > len(one[0]) + len(two[0]) * (not own[row].as_py()):
                    dense.append(pair[row].as_py())
                    continue
                out.append((np.maximum(one[0][i], two[0][j]), np.minimum(one[0][i], two[0][j])))
            a, b = np.unique(np.stack([np.concatenate(z) for z in zip(*out)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([*a.tolist(), *[None] * len(dense)], pa.int64()),
                                              pa.array([*b.tolist(), *[None] * len(dense)], pa.int64()),
                                              pa.array([*[None] * len(a), *dense], pa.int64())], names=["a", "b", "pair"])
    return run


def _joining(share):
    """Of two parts of cells (one row: a part with itself), the links that join
    components, verified on the whole sets."""
    def run(group: pa.Table) -> pa.Table:
        sides = [m.values for m in group.sort_by("side").column("m")]
        one, two = _members(sides[0]), _members(sides[-1])
        i, j = _close(one, two, len(sides) == 1, group.column("number")[0].as_py(), share)
        items, items2 = ([np.frombuffer(v, np.uint64) for v in m.field("items").to_pylist()] for m in (sides[0], sides[-1]))
        take = _forest(one[1][i], two[1][j], lambda k: _reaches(items[i[k]], items2[j[k]], share))
        a, b = one[0][i[take]], two[0][j[take]]
        return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64())})
    return run


def _large_groups(members: DataFrame) -> DataFrame:
    """(key, number) of the groups of over ``CELL`` members, the largest first."""
    large = members.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > CELL)
    return stored(large.orderBy(F.desc("size"), "key").select("key", F.monotonically_increasing_id().alias("number")), "large-groups")


def _cells(members: DataFrame, large_groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of groups' members (key, rep, component) the cells (id, x: its members) and
    the pairs of cells (a, b) to compare; a = b: a cell with itself; with the number
    of the first large group that has them (others: LAST). A component of
    over ``CELL`` members of a group has cells of its own, which are not compared
    with each other; the others stay whole in cells of several components. Equal
    cells of several groups are one."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("own"))
    several = sizes.groupBy("key").agg(F.count("*").alias("components"), F.sum(F.when(F.col("own") <= CELL, F.col("own"))).alias("rest"))
    several = several.where("components > 1").select("key", F.ceil(F.col("rest") / CELL).cast("int").alias("mixed"))
    large = sizes.where(F.col("own") > CELL).select("key", "component", F.ceil(F.col("own") / CELL).cast("int").alias("parts"))
    placed = members.join(several, "key").join(large, ["key", "component"], "left")
    alone = F.col("parts").isNotNull()
    placed = placed.select("key", "rep", F.when(alone, F.col("component")).otherwise(-1).alias("home"),
                           F.when(alone, F.pmod(F.xxhash64("rep"), F.col("parts")))
                           .otherwise(F.pmod(F.xxhash64("component"), F.col("mixed"))).alias("cell"))
    lists = placed.groupBy("key", "home", "cell").agg(F.sort_array(F.collect_list("rep")).alias("x"))  # of about CELL members
    lists = stored(lists.withColumn("id", F.struct(F.size("x").alias("n"), F.xxhash64("x").alias("h0"), F.xxhash64("x", F.lit(1)).alias("h1"))), "lists")
    numbered = lists.withColumn("number", F.lit(LAST))
    if large_groups is not None:
        numbered = lists.join(large_groups, "key", "left").withColumn("number", F.coalesce("number", F.lit(LAST)))
    a = numbered.select("key", "number", F.col("home").alias("p"), F.col("cell").alias("s"), F.col("id").alias("a"))
    b = lists.select("key", F.col("home").alias("q"), F.col("cell").alias("t"), F.col("id").alias("b"))
    two = a.join(b, "key").where("(p < q) OR (p = q AND p = -1 AND s < t)").select("a", "b", "number")
    own = numbered.where("home = -1").select(F.col("id").alias("a"), F.col("id").alias("b"), "number")
    pairs = two.unionAll(own).groupBy("a", "b").agg(F.min("number").alias("number"))
    return lists.select("id", "x").dropDuplicates(["id"]), stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "cell-pairs")


def _with_component(df: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Add ``component`` to rows with ``rep``; alone, a class is its own."""
    if comp is None:
        return df.withColumn("component", F.col("rep"))
    return df.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))


def _merged(comp: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components after more links."""
    if links.isEmpty():
        return comp
    if comp is not None:
        links = links.unionAll(comp.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return stored(components(links), "components")


def _near_pairs(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    small = sets.select("rep", "n", "sketch")
    return (pairs.join(small.toDF("a", "na", "sa"), "a").join(small.toDF("b", "nb", "sb"), "b")
            .select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near(share), "a long, b long"))


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    a = sets.select(F.col("rep").alias("a"), F.col("items").alias("xa"))
    b = sets.select(F.col("rep").alias("b"), F.col("items").alias("xb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "xa", "xb").mapInArrow(
        _linked(share), "a long, b long")


def _within(pairs: DataFrame, cells: DataFrame, known: DataFrame, share: int) -> DataFrame:
    """Links that join components across pairs of cells, verified where the cells
    meet: a task has two parts of cells with their whole sets at a time."""
    pairs = stored(pairs.select("a", "b", "number"), "dense-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    m = stored(cells.join(ids, "id", "left_semi").select("id", F.explode("x").alias("rep")), "dense-members").join(known, "rep")
    parts = m.groupBy("id").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    m = m.join(parts, "id").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    packed = stored(m.groupBy("id", "part").agg(
        F.collect_list(F.struct("rep", "component", "n", "sketch", "large", "items")).alias("m")), "dense-cells")
    at = packed.select("id", "part")
    two = (pairs.join(at.toDF("a", "p"), "a").join(at.toDF("b", "q"), "b").where("a <> b OR p <= q")
           .withColumn("pair", F.monotonically_increasing_id()))
    two = stored(two, "dense-parts")
    sides = two.select("pair", "number", F.lit(0).alias("side"), F.col("a").alias("id"), F.col("p").alias("part")).unionAll(
        two.where("a <> b OR p < q").select("pair", "number", F.lit(1).alias("side"), F.col("b").alias("id"), F.col("q").alias("part")))
    return (sides.join(packed, ["id", "part"]).select("pair", "number", "side", "m")
            .groupBy("pair").applyInArrow(_joining(share), "a long, b long"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    k: int = 5, share: int = 75) -> DataFrame:
    """One row per input row: id, text_hash, n_shingles, class_id (smallest id
    with the same set) and component_id (smallest id reachable by links of
    ``100 * intersection >= share * union`` between ``k``-word shingle sets)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))
    prof = stored(rows.select("id", "text", "text_hash").mapInArrow(
        trimmed(sliced(_profiles(k))), "id long, text_hash long, n long, cls long"), "profiles")
    # classes; the row that stands for one is its smallest (id, text_hash)
    reps = (prof.where("n > 0").groupBy("cls", "n")
            .agg(F.min(F.struct("id", "text_hash")).alias("r"), F.min("id").alias("class_id"))
            .select("cls", "n", F.col("r.id").alias("rid"), F.col("r.text_hash").alias("rhash"), "class_id"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "classes")
    total = reps.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // GROUP))
    # one row stands for a class; the others' shingles would count as held elsewhere
    firsts = _semi(rows, reps.select("rid", "rhash"))
    held = (firsts.select("text").mapInArrow(trimmed(sliced(_requests(k, buckets))), "bucket int, block long, keys binary, several binary, gaps binary, counts binary")
            .groupBy("bucket").applyInPandas(_held_elsewhere, "block long, cls binary, n binary, owners binary, held binary"))
    possible = held.groupBy("block").applyInPandas(_possible(share), "cls long").distinct()
    kept = stored(reps.join(possible, "cls", "left_semi"), "possible")
    chosen = _semi(rows, kept.select("rid", "rhash", "rep"), "rep")
    sets = stored(chosen.select("rep", "text").mapInArrow(
        trimmed(sliced(_whole_sets(k))), "rep long, n long, items binary, sketch binary"), "sets")
    comp, words = None, stored(_groups(stored(_words(sets, share), "words")), "groups")
    for r in range(HUB_ROUNDS):
        now = _with_component(words, comp)
        order = F.xxhash64("rep", F.lit(r))
        hubs = now.groupBy("key").agg(
            F.min_by("rep", order).alias("hub"), F.min_by("component", order).alias("hub_component"),
            F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").drop("c0", "c1")
        # only groups that still span several components go on to the next round
        open_now = stored(now.join(hubs, "key"), "open-words")
        pairs = (open_now.where("component <> hub_component")
                 .select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct())
        comp = _merged(comp, stored(_verified(_near_pairs(pairs, sets, share), sets, share), "links"))
        words = open_now.select("rep", "key")

    # groups that span several components: compare across these
    members = stored(_with_component(words, comp), "open-members")
    large = _large_groups(members)
    cells, pairs = _cells(members, large)
    by_rep = members.join(large, "key").groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("number")), 1, LARGEST).alias("large"))
    sketches = stored(sets.select("rep", "n", "sketch").join(by_rep, "rep", "left").withColumn(
        "large", F.coalesce("large", F.expr("cast(array() as array<bigint>)"))), "sketches")
    # first the nearest pairs that join components, which joins most that can be; then all that are left
    for nearest in (True, False):
        known = _with_component(sketches, comp)
        # a member is joined once for each cell that has it, not for each pair of cells
        held = stored(cells.select("id", F.explode("x").alias("rep")).join(known, "rep").groupBy("id").agg(
            F.min("component").alias("c0"), F.max("component").alias("c1"),
            F.collect_list(F.struct("rep", "component", "n", "sketch", "large")).alias("m")), "cells")
        spans = held.select("id", "c0", "c1")
        left = (pairs.join(spans.toDF("a", "a0", "a1"), "a").join(spans.toDF("b", "b0", "b1"), "b")
                .where("NOT (a0 = a1 AND b0 = b1 AND a0 = b0)").select("a", "b", "number", "pair"))
        across = stored(left.join(held.select(F.col("id").alias("a"), F.col("m").alias("x")), "a")
                        .join(held.select(F.col("id").alias("b"), F.col("m").alias("y")), "b")
                        .select("pair", (F.col("a") == F.col("b")).alias("own"), "number", "x", "y")
                        .mapInArrow(_across(share, nearest), "a long, b long, pair long"), "across")
        links = _verified(across.where("pair IS NULL").select("a", "b").distinct(), sets, share)
        dense = across.where("pair IS NOT NULL").select("pair")
        if not dense.isEmpty():
            links = links.unionAll(_within(pairs.join(dense, "pair"), cells, known.join(sets.select("rep", "items"), "rep"), share))
        comp = _merged(comp, stored(links, "links"))

    # the smallest document id of each component's classes
    named = _with_component(reps, comp).select("cls", "n", "class_id", "component")
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "component").select("cls", "n", "class_id", "component_id")
    out = prof.join(named, ["cls", "n"], "left")
    return out.select("id", "text_hash", F.col("n").alias("n_shingles"),
                      F.coalesce("class_id", "id").alias("class_id"),
                      F.coalesce("component_id", "id").alias("component_id"))


#: Rows of a broadcast side, counted first.
BROADCAST_ROWS = 1_000_000


def _semi(rows: DataFrame, side: DataFrame, *keep: str) -> DataFrame:
    """Rows of ``rows`` whose (id, text_hash) is in ``side``, one for each."""
    side = side.withColumnsRenamed({"rid": "__rid", "rhash": "__rhash"})
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    on = rows["id"].eqNullSafe(side["__rid"]) & rows["text_hash"].eqNullSafe(side["__rhash"])
    return rows.join(side, on).select("text", *keep)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: int = 75) -> DataFrame:
    """``docs``, all columns, with one document of each component: the one with
    its smallest id (of repeated rows, one; of documents without any id in their
    component, each different text). Documents without shingles all stay."""
    c = stored(jaccard_classes(docs, id_col, text_col, k, share), "near-classes").where("n_shingles > 0")
    named = c.select("id", "text_hash", F.col("id").eqNullSafe(F.col("component_id")).alias("is_first"))
    gone = named.where(~F.col("is_first")).select("id", "text_hash").distinct()
    twice = (named.where("is_first").groupBy("id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1")
             .select("id", "text_hash"))
    d = docs.withColumns({"__id": F.col(f"`{id_col}`").cast("long"), "__hash": F.xxhash64(F.col(f"`{text_col}`"))})
    columns = [F.col(f"`{x}`") for x in docs.columns]

    def without(rows, side, how="left_anti"):
        s = side.toDF("__sid", "__shash")
        if s.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            s = F.broadcast(s)
        return rows.join(s, F.col("__id").eqNullSafe(F.col("__sid")) & (F.col("__hash") == F.col("__shash")), how)

    out = without(d, gone)
    twice = stored(twice, "repeated-rows")
    if twice.isEmpty():
        return out.select(*columns)
    once = without(out, twice, "left_semi").dropDuplicates(["__id", "__hash"])
    return without(out, twice).unionByName(once).select(*columns)

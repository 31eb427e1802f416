"""Operator 1, language-model scoring by a weighted backoff automaton.

The model is an n-gram model smoothed towards the shorter history with a
Dirichlet prior [MacKay and Peto 1995]: with history h, its shorter h', count c
and strength s, p(w|h) = (c(hw) + s p(w|h')) / (c(h) + s); without history
p(w) = (c(w) + 1) / (N + V + 1). As an automaton: states are the histories seen
in training; a seen n-gram hw is an arc with weight log p(w|h); the failure arc
of h leads to h' with weight log(s / (c(h) + s)), taken when hw was not seen.
Reading a text from left to right, a token takes failure arcs until an arc for
it exists, adds all their weights, and moves to the longest state of the words
read.

The automaton of a whole corpus fits no task, so only the part that a block of
documents can reach is brought to it:

1. Documents become blocks of coded tokens, stored.
2. Each block asks for the counts of its n-grams and reports its own training
   counts, as arrays by hash bucket. A bucket's group adds the counts up and
   answers each block in the order of its request. Buckets are as many as keep
   a group within a fixed size, and an n-gram, however frequent, is one entry
   of a block.
3. Answers meet their block, which builds its states, arcs and failure arcs and
   walks its texts, many side by side, each carrying its state.

Training rows are those whose crc32 of the id's decimal text, mod 7, is not 2.

Defined cases: a NULL or empty text is the end token alone; a NULL id counts as
the empty text in crc32 and is returned as NULL; repeated rows are scored (and
learned from) each; unknown words share the smallest probability; without any
training row N and V are 0. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import binascii

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm.base import ship, sliced, stored
from tipscope.llm.tokens import BASE, Words, mix

ship(__name__)

#: Tokens of a block, and keys of a bucket's group, about.
BLOCK, GROUP = 1 << 19, 1 << 21
FOLDS, HELD_OUT = 7, 2
ORDER, STRENGTH = 2, 300.0
#: Tokens that one piece of a text reads in a row.
SPAN = 256
#: Codes of the start of a text (a history only) and of its end.
START, END = 0x243F6A8885A308D3, 0x13198A2E03707344
CHUNK = "chunk long, ids binary, known_id binary, counts binary, held binary, codes binary, vocab binary"


def held_out(i) -> bool:
    return binascii.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT


def halves(codes):
    """Codes as their low and then their high 16 bits, which compresses better."""
    return codes.astype(np.uint16).tobytes() + (codes >> np.uint32(16)).astype(np.uint16).tobytes()


def joined(raw):
    low, high = np.frombuffer(raw, np.uint16).reshape(2, -1).astype(np.int64)
    return low + (high << 16)


def small(x):
    """Counts in one byte each where all fit, else in eight."""
    return x.astype(np.uint8 if not len(x) or x.max() < 256 else np.int64).tobytes()


def counts_of(raw, n):
    return np.frombuffer(raw, np.uint8 if len(raw) == n else np.int64)


def _blocks(batches):
    """Blocks of documents: ids, tokens of each (without the start), and the
    tokens as codes into the block's sorted distinct word hashes."""
    words = Words()
    ids, counts, parts, size = [], [], [], 0

    def flush():
        vocab, codes = np.unique(np.concatenate([*parts, np.array([END], np.uint64)]), return_inverse=True)
        n = np.array(counts, np.int64) + 1
        ends = np.cumsum(n) - 1
        seq = np.empty(ends[-1] + 1, np.uint32)
        inner = np.ones(len(seq), bool)
        inner[ends] = False
        seq[inner], seq[ends] = codes[:-1], codes[-1]
        chunk = mix(vocab[seq] + np.arange(len(seq), dtype=np.uint64)).sum(dtype=np.uint64)
        row = (int(chunk.view(np.int64)),
               np.array([i or 0 for i in ids], np.int64).tobytes(),
               np.array([i is not None for i in ids]).tobytes(), n.tobytes(),
               np.array([held_out(i) for i in ids]).tobytes(), halves(seq), vocab.tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([x], pa.int64() if j == 0 else pa.binary()) for j, x in enumerate(row)],
            names=["chunk", "ids", "known_id", "counts", "held", "codes", "vocab"])

    for b in batches:
        h, n = words.hashes(b.column(1).to_pylist())
        at = 0
        for i, c in zip(b.column(0).to_pylist(), n):
            ids.append(i)
            counts.append(int(c))
            parts.append(h[at:at + c])
            at, size = at + c, size + int(c) + 1
            if size >= BLOCK:
                yield flush()
                ids, counts, parts, size = [], [], [], 0
    if ids:
        yield flush()


def ngrams(row, order):
    """For each order up to ``order``: keys of the block's distinct n-grams and,
    for each token, the place of the n-gram that ends there and of its history
    among those one shorter (-1 at order 1). An n-gram doesn't reach past the
    start of its text; one start token stands for all that come before."""
    codes = joined(row["codes"])
    vocab = np.frombuffer(row["vocab"], np.uint64)
    n = np.frombuffer(row["counts"], np.int64)
    first = np.cumsum(n) - n
    place = np.arange(len(codes)) - np.repeat(first, n)  # within the text
    levels = [(vocab, codes, None)]
    for k in range(2, order + 1):
        # the history is the (k-1)-gram that ends at the token before; -1: the start
        keys, at, _ = levels[-1]
        history = np.where(place >= 1, np.roll(at, 1), -1)
        pair = (history + 1) * len(vocab) + codes
        pairs, at_k = np.unique(pair, return_inverse=True)
        h, w = pairs // len(vocab) - 1, pairs % len(vocab)
        base = np.where(h >= 0, keys[h], np.uint64(START))
        levels.append((mix(base * np.uint64(BASE) + vocab[w] + np.uint64(k)), at_k, history))
    return levels


def _by_bucket(keys, buckets):
    """(bucket, places of its keys) of the buckets that have any. Within a bucket a
    key is told by its low 48 bits."""
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, start = np.unique(bucket[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, start[1:])))


def _requests(order, buckets):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                n = np.frombuffer(row["counts"], np.int64)
                learn = np.repeat(~np.frombuffer(row["held"], bool), n)
                out = []
                for k, (keys, at, _) in enumerate(ngrams(row, order), 1):
                    own = np.bincount(at[learn], minlength=len(keys))
                    low, high = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint16)
                    for x, i in _by_bucket(keys, buckets):
                        out.append((x, row["chunk"], k, low[i].tobytes() + high[i].tobytes(), small(own[i])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in out], t) for j, t in enumerate(
                        (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                    names=["bucket", "chunk", "k", "keys", "own"])
    return run


def _totals(group: pd.DataFrame) -> pd.DataFrame:
    """The corpus count of every n-gram that a block asked for, in its order,
    and the bucket's number of trained tokens and distinct ones."""
    out = []
    for k, g in group.groupby("k"):
        n = [len(x) // 6 for x in g["keys"]]
        keys = np.concatenate([np.frombuffer(x, np.uint32, c) + (
            np.frombuffer(x, np.uint16, c, 4 * c).astype(np.uint64) << np.uint64(32)) for x, c in zip(g["keys"], n)])
        own = np.concatenate([counts_of(x, c) for x, c in zip(g["own"], n)])
        distinct, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, weights=own, minlength=len(distinct)).astype(np.int64)
        answer, ends = total[at], np.cumsum(n)
        out.append(pd.DataFrame({
            "chunk": g["chunk"], "k": k, "bucket": g["bucket"],
            "totals": [small(answer[e - c:e]) for e, c in zip(ends, n)], "tokens": 0, "words": 0}))
        if k == 1:
            out[-1].loc[out[-1].index[0], ["tokens", "words"]] = [total.sum(), (total > 0).sum()]
    return pd.concat(out)


class Automaton:
    """What a block's texts can reach of the model. A state is a level (words of
    history) and a number: 0 the start of a text, i + 1 the block's i-th distinct
    history of that level; level 0 has the empty history alone. ``arcs[k]`` lists the
    arcs from level k, sorted by state and word, with their weights and where they
    lead; ``fail[k]`` and ``fail_weight[k]`` are the failure arcs of level k."""

    def __init__(self, levels, counts, texts, tokens, words, strength):
        order, self.kinds = len(levels), len(levels[0][0])
        self.word_weight = np.log10((counts[0] + 1) / (tokens + words + 1))
        self.arcs, self.fail, self.fail_weight = [None], [None], [None]
        weight = self.word_weight
        for k in range(1, order):  # histories of k words, n-grams of k + 1
            _, at, history = levels[k]
            size = len(levels[k][0])
            gram, first = np.unique(at, return_index=True)  # a place where each n-gram stands
            state, word, below = history[first] + 1, levels[0][1][first], levels[k - 1][1][first]
            seen = np.concatenate(([texts], counts[k - 1]))[state]
            c = counts[k]
            p = np.log10((c + strength * 10.0 ** weight[below]) / (seen + strength))
            has = np.flatnonzero(c > 0)
            key = state[has] * self.kinds + word[has]
            order_ = np.argsort(key, kind="stable")
            # an n-gram that is a history leads to its own state, the longest to its suffix's
            to = has[order_] + 1 if k + 1 < order else below[has[order_]] + 1
            self.arcs.append((key[order_], p[has[order_]], to))
            held = np.concatenate(([texts], counts[k - 1]))
            self.fail_weight.append(np.log10(strength / (held + strength)))
            shorter = np.zeros(len(held), np.int64)  # the start fails to the empty history
            if k > 1:
                g, f = np.unique(levels[k - 1][1], return_index=True)
                shorter[g + 1] = levels[k - 2][1][f] + 1
            self.fail.append(shorter)
            weight = np.where(c > 0, p, np.log10(strength / (seen + strength)) + weight[below])
            assert len(gram) == size

    def step(self, level, state, word):
        """Read one word in each of several states: new levels, states, weights."""
        total = np.zeros(len(word))
        to_level, to_state = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        level, state, left = level.copy(), state.copy(), np.ones(len(word), bool)
        top = len(self.arcs) - 1
        for k in range(top, 0, -1):
            i = np.flatnonzero(left & (level == k))
            if not len(i):
                continue
            keys, weights, to = self.arcs[k]
            want = state[i] * self.kinds + word[i]
            at = np.searchsorted(keys, want)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == want[hit]
            j, a = i[hit], at[hit]
            total[j] += weights[a]
            to_level[j], to_state[j] = min(k + 1, top), to[a]
            left[j] = False
            j = i[~hit]  # the failure arc
            total[j] += self.fail_weight[k][state[j]]
            level[j], state[j] = k - 1, self.fail[k][state[j]]
        i = np.flatnonzero(left)  # at the empty history every word has an arc
        total[i] += self.word_weight[word[i]]
        to_level[i], to_state[i] = min(1, top), word[i] + 1
        return to_level, to_state, total


def traverse(machine, codes, first, n, order):
    """Weight of each token, from left to right with the state carried along. Long
    texts are read in pieces of SPAN tokens side by side; a piece begins order - 1
    tokens early, without their weights, which is all that a state remembers."""
    pieces = -(-n // SPAN)
    text = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[text] + nth * SPAN
    stop = np.minimum(begin + SPAN, first[text] + n[text])
    at = np.maximum(begin - (order - 1), first[text])
    top = min(1, order - 1)
    level = np.where(at == first[text], top, 0)  # the start of a text is a state
    state = np.zeros(len(text), np.int64)
    out = np.zeros(len(codes))
    alive = np.arange(len(text))
    while len(alive):
        level_, state_, weight = machine.step(level[alive], state[alive], codes[at[alive]])
        level[alive], state[alive] = level_, state_
        own = at[alive] >= begin[alive]
        out[at[alive][own]] = weight[own]
        at[alive] += 1
        alive = alive[at[alive] < stop[alive]]
    return out


def _walk(order, buckets, tokens, words, strength):
    """Build a block's automaton from the answers and walk its texts."""
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in chunk.iterrows():
            got = {(a.k, a.bucket): a.totals for a in answers.itertuples()}
            levels = ngrams(row, order)
            n = np.frombuffer(row["counts"], np.int64)
            first = np.cumsum(n) - n
            end = int(np.searchsorted(levels[0][0], np.uint64(END)))
            count = []
            for k, (keys, _, _) in enumerate(levels, 1):
                c = np.zeros(len(keys), np.int64)
                for x, i in _by_bucket(keys, buckets):
                    c[i] = counts_of(got[k, x], len(i))
                count.append(c)
            codes = levels[0][1]
            # training texts: as often as their end, the start was seen
            machine = Automaton(levels, count, count[0][end], tokens, words, strength)
            weight = traverse(machine, codes, first, n, order)
            out.append(pd.DataFrame({
                "doc_id": pd.array(np.frombuffer(row["ids"], np.int64), "Int64"),
                "held_out": np.frombuffer(row["held"], bool), "n_tokens": n,
                "n_known": np.add.reduceat((count[0][codes] > 0).astype(np.int64), first),
                "train_tokens": tokens, "base_score": np.add.reduceat(machine.word_weight[codes], first),
                "score": np.add.reduceat(weight, first)}))
            out[-1].loc[~np.frombuffer(row["known_id"], bool), "doc_id"] = pd.NA
        return pd.concat(out)
    return run


def score(docs: DataFrame, id_col="doc_id", text_col="text", order=ORDER, strength=STRENGTH) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score, log10 probabilities."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    chunks = stored(rows.mapInArrow(sliced(_blocks), CHUNK), "lm-blocks")
    size = chunks.agg(F.sum(F.length("codes") / 4 * order)).first()[0] or 0
    buckets = max(1, -(-int(size) // GROUP))
    asked = chunks.mapInArrow(_requests(order, buckets), "bucket int, chunk long, k int, keys binary, own binary")
    answers = stored(asked.groupBy("bucket").applyInPandas(
        _totals, "chunk long, k int, bucket int, totals binary, tokens long, words long"), "lm-counts")
    tokens, words = answers.agg(F.sum("tokens"), F.sum("words")).first()
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        _walk(order, buckets, tokens or 0, words or 0, strength),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Operator 8, main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level
tags, each with its path of tags and their class, id and role words. A block's
vector holds its hashed path, its hashed words and a few sizes. A bidirectional
LSTM in numpy reads a page's vectors and labels every block as main text or not,
so that each label depends on the whole page. The text is the labelled blocks,
joined in page order.

The labeller is trained on at most ``max_train`` pages (those with the smallest
hash of the id) whose blocks a rule on path words has labelled; the rule is for
training only.

Defined cases: a NULL or empty html, or a page without main text, gives an empty
text; unclosed tags, stray end tags, comments without an end and cut-off
character references are read as browsers do, about; repeated rows are extracted
each; a NULL id or url is kept; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm.base import ship
from tipscope.llm.logistic import sigmoid
from tipscope.llm.tokens import Words

ship(__name__)

MAX_TRAIN = 400
PATH, WORDS, SIZES, HIDDEN = 96, 32, 5, 12
EPOCHS, RATE, SEED = 14, 0.02, 5
#: Pages read, and padded blocks labelled, at a time.
STEP, PAD = 256, 1 << 14

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>"""
                 r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript template iframe svg math object textarea".split())
#: What a start tag ends when it is open within the same container.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
CONTAINER = frozenset("article aside body div dl footer form header main nav ol section table td th ul".split())
#: Path words that speak for and against main text when labels are made for training.
MAIN = frozenset("article main content post entry story".split())
AROUND = frozenset(
    "nav menu navbar footer aside sidebar notice notices cookie cookies consent banner ad ads advert adverts "
    "advertisement promo sponsor sponsored form button select script style comment comments reply replies "
    "discussion disqus share sharing social related breadcrumb breadcrumbs pagination popup modal subscribe "
    "newsletter widget copyright login search noscript alert legal toolbar masthead".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())


def blocks(page):
    """(path words, text) of each block with text, in page order."""
    out, stack, parts, path, at = [], [("", ())], [], None, 0

    def close():
        nonlocal parts, path
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((path, text))
        parts, path = [], None

    def add(raw):
        nonlocal path
        if raw:
            parts.append(raw)
            if path is None and raw.strip():
                path = stack[-1][1]

    def pop(names):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in CONTAINER:
                return

    while m := TAG.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            close()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if name in INLINE and stack[i][0] in CONTAINER:
                    break
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        pop(ENDS.get(name, ()))
        if name not in VOID:
            words = [name]
            for x in NAMES.finditer(m[3] or m[6] or ""):
                words += PART.findall((x[1] or x[2] or x[3] or "").lower())
            stack.append((name, stack[-1][1] + tuple(words)))
    add(page[at:])
    close()
    return out


def weak_labels(page):
    """0/1 of each block of one page, by its path; for training only."""
    has_main = any(MAIN & set(path) for path, _ in page)
    out = []
    for path, text in page:
        s = set(path)
        if AROUND & s or ("header" in s and not MAIN & s):
            out.append(0)
        elif has_main:
            out.append(int(bool(MAIN & s)))
        else:
            out.append(int(bool(TEXT_TAGS & s) or len(text) >= 80))
    return out


class Vectors:
    """Turns pages' blocks into vectors."""

    def __init__(self):
        self.words, self.paths = Words(), {}

    def path(self, p):
        if p not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            v = np.zeros(PATH, np.float32)
            for w in set(p):
                v[zlib.crc32(w.encode()) % PATH] = 1
            self.paths[p] = v
        return self.paths[p]

    def __call__(self, pages):
        flat = [b for p in pages for b in p]
        x = np.zeros((len(flat), PATH + WORDS + SIZES), np.float32)
        if not flat:
            return x
        h, n = self.words.hashes([t for _, t in flat])
        row = np.repeat(np.arange(len(flat)), n)
        bag = np.bincount(row * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=len(flat) * WORDS)
        x[:, :PATH] = [self.path(p) for p, _ in flat]
        x[:, PATH:PATH + WORDS] = bag.reshape(len(flat), WORDS) / np.maximum(n, 1)[:, None]
        x[:, PATH + WORDS] = np.log1p(n) / 5
        x[:, PATH + WORDS + 1] = ["a" in p for p, _ in flat]
        x[:, PATH + WORDS + 2] = [t[-1] in ".!?" for _, t in flat]
        x[:, PATH + WORDS + 3] = np.concatenate([np.arange(len(p)) / len(p) for p in pages if p])
        x[:, -1] = 1
        return x


def batches_of(lengths):
    """Groups of pages of like length, each of at most PAD padded blocks."""
    group = []
    for i in np.argsort(lengths, kind="stable"):
        if lengths[i]:
            if group and lengths[i] * (len(group) + 1) > PAD:
                yield group
                group = []
            group.append(int(i))
    if group:
        yield group


def padded(x, begin, lengths, group):
    """x and mask as (step, page, ...)."""
    steps = max(lengths[i] for i in group)
    out, mask = np.zeros((steps, len(group), x.shape[1]), np.float32), np.zeros((steps, len(group), 1), np.float32)
    for j, i in enumerate(group):
        out[:lengths[i], j], mask[:lengths[i], j] = x[begin[i]:begin[i] + lengths[i]], 1
    return out, mask


def start_weights(rng):
    d = PATH + WORDS + SIZES
    one = lambda: [rng.normal(0, 0.1, (d, 4 * HIDDEN)), rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)), np.zeros(4 * HIDDEN)]
    w = [*one(), *one(), rng.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)]
    w[2][HIDDEN:2 * HIDDEN] = w[5][HIDDEN:2 * HIDDEN] = 1  # open forget gates
    return w


def read(x, mask, wx, wh, b, order):
    """Hidden states of one direction, and what its gradient needs."""
    pre = x @ wx + b
    h = c = np.zeros((x.shape[1], HIDDEN))
    hs, kept = np.zeros((len(x), x.shape[1], HIDDEN)), {}
    for t in order:
        z = pre[t] + h @ wh
        i, f, o = (sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        c_new = f * c + i * g
        s = np.tanh(c_new)
        kept[t] = (i, f, o, g, s, c, h)
        c = mask[t] * c_new + (1 - mask[t]) * c
        h = mask[t] * o * s + (1 - mask[t]) * h
        hs[t] = h
    return hs, kept


def gradient(x, mask, wh, kept, order, dhs):
    """Gradients of one direction's weights."""
    dh = dc = np.zeros((x.shape[1], HIDDEN))
    dwh, dz_all = np.zeros_like(wh), np.zeros((len(x), x.shape[1], 4 * HIDDEN))
    for t in reversed(order):
        i, f, o, g, s, c, h = kept[t]
        dh = dh + dhs[t]
        m = mask[t]
        dht, do = dh * m, dh * m * s
        dct = dc * m + dht * o * (1 - s * s)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - g * g)], 1)
        dz_all[t] = dz
        dwh += h.T @ dz
        dh = dh * (1 - m) + dz @ wh.T
        dc = dc * (1 - m) + dct * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return [x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)]


def forward(w, x, mask):
    there, back = range(len(x)), range(len(x) - 1, -1, -1)
    hf, kf = read(x, mask, *w[0:3], there)
    hb, kb = read(x, mask, *w[3:6], back)
    h = np.concatenate([hf, hb], 2)
    return h @ w[6] + w[7], h, kf, kb


def train(pages, labels):
    """Weights after EPOCHS rounds of Adam."""
    rng = np.random.default_rng(SEED)
    w = start_weights(rng)
    x, lengths = Vectors()(pages), np.array([len(p) for p in pages], np.int64)
    begin, y = np.cumsum(lengths) - lengths, np.concatenate([np.array(q, float) for q in labels] or [np.zeros(0)])
    m, v, step = [np.zeros_like(q) for q in w], [np.zeros_like(q) for q in w], 0
    for _ in range(EPOCHS if len(y) else 0):
        mixed = rng.permutation(len(pages))
        for k in range(0, len(mixed), 32):
            group = [int(i) for i in mixed[k:k + 32] if lengths[i]]
            if not group:
                continue
            xs, mask = padded(x, begin, lengths, group)
            ys, _ = padded(y[:, None], begin, lengths, group)
            z, h, kf, kb = forward(w, xs, mask)
            dz = (sigmoid(z) - ys[:, :, 0]) * mask[:, :, 0] / mask.sum()
            dh = dz[:, :, None] * w[6]
            n = len(xs)
            grads = [*gradient(xs, mask, w[1], kf, range(n), dh[:, :, :HIDDEN]),
                     *gradient(xs, mask, w[4], kb, range(n - 1, -1, -1), dh[:, :, HIDDEN:]),
                     np.einsum("tb,tbh->h", dz, h), np.array([dz.sum()])]
            step += 1
            for j, q in enumerate(grads):
                m[j] += 0.1 * (q - m[j])
                v[j] += 0.01 * (q * q - v[j])
                w[j] = w[j] - RATE * (m[j] / (1 - 0.9 ** step)) / (np.sqrt(v[j] / (1 - 0.99 ** step)) + 1e-8)
    return w


def labelled(w, vectors, pages):
    """Whether each block of each page is main text."""
    lengths = np.array([len(p) for p in pages], np.int64)
    x, begin, out = vectors(pages), np.cumsum(lengths) - lengths, [[] for _ in pages]
    for group in batches_of(lengths):
        z = forward(w, *padded(x, begin, lengths, group))[0]
        for j, i in enumerate(group):
            out[i] = z[:lengths[i], j] > 0
    return out


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["order", "html"], na_position="first")
    pages = [blocks(t or "") for t in group["html"]]
    w = train(pages, [weak_labels(p) for p in pages])
    return pd.DataFrame({"model": [np.concatenate([np.ravel(q) for q in w]).tobytes()]})


def _unpack(raw):
    w, at = start_weights(np.random.default_rng(SEED)), 0
    flat = np.frombuffer(raw) if raw else np.concatenate([np.ravel(q) for q in w])
    for j, q in enumerate(w):
        w[j] = flat[at:at + q.size].reshape(q.shape).astype(np.float32)
        at += q.size
    return w


def _extract(raw):
    def run(batches):
        w, vectors = _unpack(raw), Vectors()
        for b in batches:
            texts = []
            for k in range(0, b.num_rows, STEP):
                pages = [blocks(t or "") for t in b.column(2).slice(k, STEP).to_pylist()]
                for page, keep in zip(pages, labelled(w, vectors, pages)):
                    texts.append(" ".join(t for (_, t), is_main in zip(page, keep) if is_main))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return run


def training_pages(rows: DataFrame, bound: int) -> DataFrame:
    """(order, html) of at most ``bound`` pages. They are chosen by their ids alone;
    the chosen ids, bounded, are broadcast to read their pages, one for each id."""
    ids = (rows.select(F.col("page_id").alias("__id")).distinct().withColumn("order", F.xxhash64("__id", F.lit(3)))
           .orderBy("order", "__id").limit(bound))
    return (rows.join(F.broadcast(ids), F.col("page_id").eqNullSafe(F.col("__id")))
            .groupBy("order", "__id").agg(F.min("html").alias("html")).select("order", "html"))


def main_text(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", max_train=MAX_TRAIN) -> DataFrame:
    """One row per input row: page_id, url, text and n_chars."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").alias("html"))
    row = training_pages(rows, max_train).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_fit, "model binary").first()
    return rows.mapInArrow(_extract(row[0] if row else b""), "page_id long, url string, text string, n_chars long")

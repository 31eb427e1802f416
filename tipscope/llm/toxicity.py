"""Operator 7, toxicity by a character n-gram linear classifier whose features
are scaled by naive Bayes log-count ratios [Wang and Manning 2012].

A text's features are the distinct character 3- to 5-grams of its lower-cased
form, hashed to 2**20 places. From labelled texts: the log ratio of each
place's smoothed share in toxic and other texts; the places that tell the two
apart best (by the chi statistic of their texts) are kept; a logistic regression
is fitted on the kept 0/1 features times their ratios. Scoring takes every
n-gram of the whole text.

The fit takes at most ``max_train`` labelled rows (those with the smallest hash
of the id), never a row whose crc32 of the id's decimal text, mod 5, is 0.
Labels, language, source and id are not features.

Defined cases: a NULL or empty text has no features and scores by the
intercept; a NULL label is no label; an id labelled more than once has the
largest label; repeated rows are scored each; without labels of both classes
the scores are the prior's; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm.base import ship, sliced
from tipscope.llm.logistic import Rows, fit, sigmoid

ship(__name__)

FOLDS = 5
ORDERS, PLACES, KEPT = (3, 4, 5), 1 << 20, 1 << 10
#: Bound of the labelled rows that the fit takes.
MAX_TRAIN = 5000
SMOOTH, L2 = 1.0, 1.0


def grams(text):
    """The places of a text's character n-grams, one length after the other."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(c), np.uint64)
    for k in range(1, min(max(ORDERS), len(c)) + 1):
        h = h[:len(c) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + c[k - 1:] * np.uint64(k)
        if k in ORDERS:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield (x >> np.uint64(40)) % np.uint64(PLACES)


def features(texts, used=None):
    """(places, number of them) of each text's distinct n-grams; with ``used``,
    only those it marks."""
    sets = []
    for t in texts:
        own = [p.astype(np.int32) if used is None else p[used[p]].astype(np.int32) for p in grams(t)]
        sets.append(np.unique(np.concatenate(own)) if own else np.zeros(0, np.int32))
    return (np.concatenate(sets) if sets else np.zeros(0, np.int32)), np.array([len(s) for s in sets], np.int64)


def train(texts, labels, kept=KEPT):
    """(weights by place, intercept)."""
    y = np.asarray(labels, bool)
    places, counts = features(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    seen = np.bincount(places, minlength=PLACES)
    toxic = np.bincount(places[y[row]], minlength=PLACES)
    other = seen - toxic
    ratio = np.log((toxic + SMOOTH) / (toxic + SMOOTH).sum()) - np.log((other + SMOOTH) / (other + SMOOTH).sum())
    share = seen / max(1, len(y))
    apart = np.abs(toxic / max(1, y.sum()) - other / max(1, (~y).sum()))
    weigh = np.where(seen >= 3, apart / np.sqrt(share * (1 - share) + 1e-9), 0)
    top = np.sort(np.argpartition(-weigh, min(kept, PLACES - 1))[:kept])
    to = np.full(PLACES, -1)
    to[top] = np.arange(len(top))
    keep = to[places] >= 0
    x = Rows(to[places[keep]], np.bincount(row[keep], minlength=len(texts)), len(top))
    w, b = fit(x, y, L2, scale=ratio[top])
    weights = np.zeros(PLACES)
    weights[top] = w
    return weights, b


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["order", "text"], na_position="first")
    w, b = train([t or "" for t in group["text"]], group["label"] == 1)
    at = np.flatnonzero(w)
    return pd.DataFrame({"place": [at.astype(np.int32).tobytes()], "weight": [w[at].tobytes()], "intercept": [b]})


def _score(place, weight, intercept, held):
    def run(batches):
        weights, used = np.zeros(PLACES), np.zeros(PLACES, bool)
        weights[place], used[place] = weight, True
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            p, n = features(texts, used)
            z = np.bincount(np.repeat(np.arange(len(texts)), n), weights=weights[p], minlength=len(texts)) + intercept
            s = sigmoid(z)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(s), pa.array((s >= held).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])
    return run


def fold(c):
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, bound: int,
                  id_col="doc_id", text_col="text", more=()) -> DataFrame:
    """(order, text, label) of at most ``bound`` labelled rows outside the held-out
    fold. The rows are chosen from the labels alone; the chosen ids, bounded, are
    broadcast to read their texts."""
    lab = (labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("label"))
           .where("label is not null and __id is not null").where(fold("__id") != 0)
           .groupBy("__id").agg(F.max("label").alias("label"))
           .withColumn("order", F.xxhash64(F.col("__id"), F.lit(7))).orderBy("order", "__id").limit(bound))
    d = docs.select(F.col(f"`{id_col}`").alias("__d"), F.col(f"`{text_col}`").alias("text"), *more)
    picked = d.join(F.broadcast(lab), d["__d"] == lab["__id"])
    return picked.select("order", "text", "label", *[c for c in picked.columns if c.startswith("__m_")])


def score(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic",
          max_train=MAX_TRAIN, threshold=0.5) -> DataFrame:
    """One row per input row: doc_id, held_out, score and predicted."""
    model = training_rows(docs, labels, label_col, max_train, id_col, text_col).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(
        _fit, "place binary, weight binary, intercept double").first()
    place, weight, b = (np.frombuffer(model[0], np.int32), np.frombuffer(model[1], float), model[2]) if model else (
        np.zeros(0, np.int32), np.zeros(0), 0.0)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.withColumn("held_out", fold("doc_id") == 0).mapInArrow(
        sliced(_score(place, weight, b, threshold)), "doc_id long, held_out boolean, score double, predicted int")

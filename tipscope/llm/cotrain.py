"""Operator 4, quality by co-training [Blum and Mitchell 1998].

Two views of a document: its content (shares of hashed character 1- and 2-grams,
as roots) and its metadata (hashed values of the given columns; numbers by their
magnitude). Each view has a logistic classifier. In each round both are fitted,
score all unlabelled documents, and hand their most confident ones, with the
label they give them, to the other view's training set. At the end each
view is calibrated on labelled rows that neither view was fitted on (Platt), the
calibrated log odds are combined by a second fit on the same rows, and all
documents are scored.

Bounds of the fit: ``max_labelled`` labelled rows, chosen by the id's hash
(outside the held-out fold: crc32 of the id's decimal text, mod 5, is 0), and
the documents handed over, in each round and by each view ``HAND_OVER`` of the
unlabelled ones, of ``max_pool`` where there are more. Unlabelled are all
documents but those of the fit and the labelled ones of the held-out fold; of
equal texts one (smallest hash of the id) can be handed over.

Defined cases: a NULL or empty text has no content features; NULL metadata is a
value of its own; a NULL label is no label, so its document is unlabelled, as is
one with a NULL id; an id labelled more than once has the largest; repeated rows are scored each; without labels of both classes all
scores are the prior's; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm.base import ship, sliced, stored
from tipscope.llm.logistic import Dense, fit, sigmoid
from tipscope.llm.toxicity import fold, training_rows

ship(__name__)

CONTENT, META = 1 << 12, 1 << 10
MAX_LABELLED, MAX_POOL = 5000, 3000
ROUNDS, HAND_OVER = 4, 0.05
#: Rows of a batch that are turned into features at a time.
STEP = 256


def content(texts):
    """Roots of the shares of hashed character 1- and 2-grams."""
    out = np.zeros((len(texts), CONTENT), np.float32)
    for i, t in enumerate(texts):
        if t:
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            one = (c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            two = (c[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[1:] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            x = np.bincount(one.astype(np.int64), minlength=CONTENT) + np.bincount(two.astype(np.int64), minlength=CONTENT)
            out[i] = np.sqrt(x / x.sum())
    return out


def metadata(rows):
    """One place for each column's value, and for each pair of columns."""
    out = np.zeros((len(rows), META), np.float32)
    for i, values in enumerate(rows):
        names = [f"{j}={v}" for j, v in enumerate(values)]
        names += [f"{a}&{b}" for k, a in enumerate(names) for b in names[k + 1:]]
        for n in names:
            out[i, zlib.crc32(n.encode("utf-8", "surrogatepass")) % META] = 1
    return out


def _meta_columns(docs, cols):
    kinds = dict(docs.dtypes)
    number = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [(F.floor(F.log2(F.abs(F.col(f"`{c}`").cast("double")) + 1)).cast("string") if kinds[c] in number
             else F.col(f"`{c}`").cast("string")).alias(f"__m_{i}") for i, c in enumerate(cols)]


def fit_views(views, given):
    """(weights, intercept) of each view, fitted on the rows with a label for it."""
    return [fit(Dense(x[i]), y[i], l2=0.1) for x, y in zip(views, given) for i in [np.flatnonzero(y >= 0)]]


def combine(views, models, label):
    """Platt pair of each view and the combination, fitted on labelled rows that
    no view was fitted on."""
    odds, platt = [], []
    for x, (w, b) in zip(views, models):
        z = (x @ w + b)[:, None]
        a, c = fit(Dense(z), label, l2=1e-3)
        platt.append((a[0], c))
        odds.append(z[:, 0] * a[0] + c)
    mix, bias = fit(Dense(np.array(odds).T.reshape(len(label), len(views))), label, l2=1e-2)
    return platt, mix, bias


def _fit(n_meta):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "text", "given_0", "given_1"], na_position="first")
        views = [content(list(group["text"])), metadata(group[[f"__m_{i}" for i in range(n_meta)]].values.tolist())]
        label = group["label"].to_numpy().astype(np.int64)
        kept_out = (label >= 0) & (group["order"].to_numpy() % 4 == 0)
        given = [np.where(kept_out, -1, group[f"given_{v}"].to_numpy().astype(np.int64)) for v in range(2)]
        models = fit_views(views, given)
        platt, mix, bias = combine([x[kept_out] for x in views], models, label[kept_out])
        flat = np.concatenate([np.append(w, b) for w, b in models] + [np.ravel(platt), mix, [bias]])
        return pd.DataFrame({"model": [flat.astype(np.float64).tobytes()]})
    return run


def _odds(model, texts, meta):
    """Log odds of each view, before calibration."""
    w1, b1 = model[:CONTENT], model[CONTENT]
    w2, b2 = model[CONTENT + 1:CONTENT + 1 + META], model[CONTENT + 1 + META]
    z1 = [content(texts[i:i + STEP]) @ w1 + b1 for i in range(0, len(texts), STEP)]
    z2 = [metadata(meta[i:i + STEP]) @ w2 + b2 for i in range(0, len(texts), STEP)]
    return [np.concatenate(z) if z else np.zeros(0) for z in (z1, z2)]


def _rounded(model):
    """Scores of a round: key, order and the log odds of each view."""
    def run(batches):
        for b in batches:
            meta = list(zip(*[b.column(i).to_pylist() for i in range(3, b.num_columns)])) or [()] * b.num_rows
            z1, z2 = _odds(model, b.column(2).to_pylist(), meta)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z1), pa.array(z2)],
                                             names=["key", "order", "z0", "z1"])
    return run


def handed_over(scores: DataFrame, share: int, prior: float, given) -> list:
    """(key, label, view that gets it) of the unlabelled documents that each view
    is most sure of; ``given`` has the keys that each view was given before."""
    picks = None
    for v in range(2):
        z = F.col(f"z{v}")
        free = scores.where(~F.col("key").isin(list(given[1 - v]))) if given[1 - v] else scores
        for label, sure, order, n in ((0, z < -1, z.asc(), int(share * (1 - prior)) + 1),
                                      (1, z > 1, z.desc(), int(share * prior) + 1)):
            top = free.where(sure).orderBy(order, "key").limit(n).select("key", F.lit(label).alias("label"), F.lit(1 - v).alias("view"))
            picks = top if picks is None else picks.unionAll(top)
    return [(r.key, r.label, r.view) for r in picks.collect()]


def _score(model):
    def run(batches):
        (a1, c1), (a2, c2) = model[CONTENT + META + 2:CONTENT + META + 6].reshape(2, 2)
        m1, m2, bias = model[CONTENT + META + 6:]
        for b in batches:
            meta = list(zip(*[b.column(i).to_pylist() for i in range(3, b.num_columns)])) or [()] * b.num_rows
            z1, z2 = _odds(model, b.column(1).to_pylist(), meta)
            z1, z2 = z1 * a1 + c1, z2 * a2 + c2
            s = sigmoid(m1 * z1 + m2 * z2 + bias)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(sigmoid(z1)), pa.array(sigmoid(z2)), pa.array(s),
                 pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "content_score", "metadata_score", "score", "predicted"])
    return run


def co_train(docs: DataFrame, labels: DataFrame, id_col, text_col, label_col, meta,
             max_labelled=MAX_LABELLED, max_pool=MAX_POOL, rounds=ROUNDS):
    """The model as an array, and the documents handed over: (key, label, view)."""
    names = [f"__m_{i}" for i in range(len(meta))]
    known = stored(training_rows(docs, labels, label_col, max_labelled, id_col, text_col, meta)
                   .select("order", "text", "label", *names), "co-training-labelled")
    train = known.withColumns({"given_0": F.col("label"), "given_1": F.col("label")})
    kind = labels.schema[id_col].dataType
    d = docs.select(F.xxhash64(F.col(f"`{text_col}`")).alias("key"),
                    F.xxhash64(F.col(f"`{id_col}`").cast(kind), F.lit(7)).alias("order"),
                    F.col(f"`{text_col}`").alias("text"), *meta)
    held = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").alias("label")).where(
        "label is not null and __id is not null").where(fold("__id") == 0)
    used = known.select("order").unionAll(held.select(F.xxhash64("__id", F.lit(7)).alias("order"))).distinct()
    prior = known.agg(F.avg((F.col("label") == 1).cast("int"))).first()[0]
    prior = float(np.clip(0.5 if prior is None else prior, 0.05, 0.95))
    given, handed = [set(), set()], []
    for r in range(rounds + 1):
        row = train.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_fit(len(meta)), "model binary").first()
        model = np.frombuffer(row[0], np.float64) if row else np.zeros(CONTENT + META + 9)
        if r == rounds or not row:
            break
        z = d.mapInArrow(sliced(_rounded(model)), "key long, order long, z0 double, z1 double")
        z = (z.join(used, "order", "left_anti").groupBy("key").agg(F.min(F.struct("order", "z0", "z1")).alias("s"))
             .select("key", "s.order", "s.z0", "s.z1"))
        z = stored(z, "co-training-scores")
        picks = handed_over(z, max(1, int(HAND_OVER * z.limit(max_pool).count())), prior, given)
        if not picks:
            break
        labelled = {}
        for key, label, view in picks:
            given[view].add(key)
            labelled.setdefault(key, [-1, -1])[view] = label
        handed += picks
        chosen = docs.sparkSession.createDataFrame([(k, *g) for k, g in labelled.items()], "key long, given_0 int, given_1 int")
        new = (d.join(F.broadcast(chosen), "key").join(z.select("key", "order"), ["key", "order"], "left_semi")
               .groupBy("key", "given_0", "given_1").agg(F.min(F.struct("order", "text", *names)).alias("s"))
               .select("s.*", F.lit(-1).alias("label"), "given_0", "given_1"))
        train = train.unionByName(stored(new, "co-training-given"))
    return model, handed


def score(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality",
          meta_cols=("lang", "source", "n_chars"), max_labelled=MAX_LABELLED, max_pool=MAX_POOL) -> DataFrame:
    """One row per input row: doc_id, held_out, the calibrated score of each
    view, the combined score and predicted."""
    meta = _meta_columns(docs, meta_cols)
    model = co_train(docs, labels, id_col, text_col, label_col, meta, max_labelled, max_pool)[0]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *meta)
    rows = rows.select("doc_id", "text", (fold("doc_id") == 0).alias("held_out"), *[f"__m_{i}" for i in range(len(meta))])
    return rows.mapInArrow(sliced(_score(model)), "doc_id long, held_out boolean, content_score double, "
                                          "metadata_score double, score double, predicted int")

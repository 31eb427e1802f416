"""Operator 5, mixing sources to target weights by iterative proportional
fitting.

Documents fall into cells by their source, language and topic; a value that the
targets do not name falls into the level ``other``, so there are at most
``(|targets| + 1)`` levels of each and the table of cells is bounded by the
parameters, whatever the input. Tokens are summed by cell in one aggregation.
Raking then scales the cells' inclusion probabilities margin by margin until
the expected sampled tokens of every level meet its target share of ``fraction``
of all tokens. A probability never passes 1: what a full cell or level can't
give is taken from the others, and targets that can't be met together are eased
as far as needed, which ``report`` and ``shares`` say. Each document is kept when a uniform number made from
its id and text is below its cell's probability.

Defined cases: NULL values are ``other``; NULL or empty texts have no tokens and
are kept by the same probability; repeated rows share their number, and so their
fate; a target level without tokens is left out and the others of its margin are
scaled up; other columns are not read (a clash of names is no problem); an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipscope.llm.base import SPACE
from tipscope.llm.decontaminate import BLANK

OTHER = "other"
FRACTION, SEED, ROUNDS = 0.5, 11, 1000
#: Halvings of the step by which targets that can't be met together are eased.
EASE_STEPS = 12
#: Production targets: shares by margin; what is missing from 1 is for ``other``.
TARGETS = {
    "source": {f"src{i}": 0.045 for i in range(20)},
    "lang": {"en": 0.46, "de": 0.18, "fr": 0.18, "es": 0.14},
    "topic": {"prose": 0.86, "table": 0.05, "marked": 0.06, "shouted": 0.02, "note": 0.01},
}


def token_count(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, f"{SPACE}+"))).cast("long")


def form_topic(text: Column) -> Column:
    """A topic by the text's form: tables, marked-up text, capitals only, notes
    of under 400 characters, else prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))

    def share(characters):
        rest = t
        for c in characters:
            rest = F.replace(rest, F.lit(c), F.lit(""))
        return (n - F.length(rest)) / n

    return (F.when(share("|") > 0.03, "table").when(share("#*$%&") > 0.1, "marked")
            .when((F.upper(t) == t) & (F.lower(t) != t), "shouted").when(n < 400, "note").otherwise("prose"))


def reachable(capacity, shares, budget):
    """A margin's tokens by level: its shares of ``budget``, where no level is given
    more than its capacity and what it can't take goes to the others by theirs."""
    shares = np.where(capacity > 0, shares, 0.0)
    if shares.sum() <= 0:
        shares = capacity.copy()
    want, open_ = np.zeros(len(capacity)), capacity > 0
    while open_.any():
        left = budget - want[~open_].sum()
        rate = left / shares[open_].sum() if shares[open_].sum() > 0 else None
        if rate is None:  # only levels without a share are left
            want[open_] = left * capacity[open_] / capacity[open_].sum()
            break
        over = open_ & (shares * rate > capacity)
        if not over.any():
            want[open_] = shares[open_] * rate
            break
        want[over] = capacity[over]
        open_ &= ~over
    return np.minimum(want, capacity)


def _scaled(tokens, want, fraction, rounds, tolerance):
    """(probabilities, settled): cells scaled margin by margin; a full cell counts
    as full, so what it can't give is asked of the others of its levels."""
    factor = np.full(tokens.shape, fraction, float)
    total = max(tokens.sum(), 1.0)
    for _ in range(rounds):
        for axis, w in enumerate(want):
            rest = tuple(i for i in range(tokens.ndim) if i != axis)
            has = (np.minimum(factor, 1) * tokens).sum(axis=rest)
            scale = np.divide(w, has, out=np.ones_like(w), where=has > 0)
            shape = [1] * tokens.ndim
            shape[axis] = -1
            factor = np.clip(factor * scale.reshape(shape), 0, 1e9)
        p = np.minimum(factor, 1)
        worst = max(np.abs((p * tokens).sum(axis=tuple(i for i in range(tokens.ndim) if i != axis)) - w).max()
                    for axis, w in enumerate(want))
        if worst <= tolerance * total:
            return p, True
    return np.minimum(factor, 1), False


def rake(tokens, targets, fraction=FRACTION, rounds=ROUNDS, tolerance=1e-9):
    """(probabilities, eased): the inclusion probability of each cell.
    ``tokens``: one axis a margin; ``targets``: shares of each margin's levels.

    A level that has too few tokens for its share gives all, and the others of its
    margin take the rest. Where margins still can't be met together, all of them
    move towards the corpus's own shares, which can, by the least step ``eased``
    (0: not at all, 1: the corpus's own) that lets the raking settle. The sampled
    tokens add up to ``fraction`` of all either way."""
    tokens = np.asarray(tokens, float)
    budget = fraction * tokens.sum()
    if budget <= 0:
        return np.full(tokens.shape, min(fraction, 1.0)), 0.0
    if fraction >= 1:
        return np.ones(tokens.shape), 0.0
    own = [tokens.sum(axis=tuple(i for i in range(tokens.ndim) if i != axis)) for axis in range(tokens.ndim)]
    want = [reachable(c, np.asarray(t, float), budget) for c, t in zip(own, targets)]

    def at(eased):
        return _scaled(tokens, [(1 - eased) * w + eased * fraction * c for w, c in zip(want, own)], fraction, rounds, tolerance)

    p, settled = at(0.0)
    if settled:
        return p, 0.0
    low, high, best = 0.0, 1.0, np.full(tokens.shape, fraction, float)
    for _ in range(EASE_STEPS):
        middle = (low + high) / 2
        p, settled = at(middle)
        if settled:
            high, best = middle, p
        else:
            low = middle
    return best, high


def _level(c: Column, names) -> Column:
    return F.when(c.isin(*names), c).otherwise(F.lit(OTHER)) if names else F.lit(OTHER)


def mixed(docs: DataFrame, margins: dict[str, Column], targets=TARGETS, fraction=FRACTION, seed=SEED,
          id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with columns __tokens, __cell_<margin>, __probability, __sampled and
    __eased added."""
    names = list(targets)
    d = docs.withColumns({f"__cell_{m}": _level(margins[m].cast("string"), list(targets[m])) for m in names} | {
        "__tokens": token_count(F.col(f"`{text_col}`"))})
    cells = d.groupBy(*[f"__cell_{m}" for m in names]).agg(F.sum("__tokens")).collect()  # bounded by the targets
    levels = [[*targets[m], OTHER] for m in names]
    tokens = np.zeros([len(x) for x in levels])
    for r in cells:
        tokens[tuple(x.index(v) for x, v in zip(levels, r))] = r[-1] or 0
    shares = [[*targets[m].values(), max(0.0, 1 - sum(targets[m].values()))] for m in names]
    p, eased = rake(tokens, shares, fraction)
    rows = [(*[x[j] for x, j in zip(levels, at)], float(p[at])) for at in np.ndindex(*p.shape)]
    spark = docs.sparkSession
    table = spark.createDataFrame(rows, ", ".join([f"__p_{m} string" for m in names] + ["__probability double"]))
    on = [F.col(f"__cell_{m}") == F.col(f"__p_{m}") for m in names]
    number = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(seed))
    uniform = F.shiftrightunsigned(number, 11) / F.lit(float(1 << 53))
    return (d.join(F.broadcast(table), on).drop(*[f"__p_{m}" for m in names])
            .withColumns({"__sampled": uniform < F.col("__probability"), "__eased": F.lit(float(eased))}))


def default_margins(source_col="source", lang_col="lang", text_col="text") -> dict[str, Column]:
    return {"source": F.col(f"`{source_col}`"), "lang": F.col(f"`{lang_col}`"), "topic": form_topic(F.col(f"`{text_col}`"))}


def sample(docs: DataFrame, margins=None, **options) -> DataFrame:
    """The sampled rows of ``docs``, all columns."""
    m = mixed(docs, margins or default_margins(), **options)
    return m.where("__sampled").select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, margins=None, targets=TARGETS, id_col="doc_id", **options) -> DataFrame:
    """One row per input row: doc_id, n_tokens, its levels, probability, sampled."""
    m = mixed(docs, margins or default_margins(), targets, id_col=id_col, **options)
    return m.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("__tokens").alias("n_tokens"),
                    *[F.col(f"__cell_{x}").alias(f"{x}_level") for x in targets],
                    F.col("__probability").alias("probability"), F.col("__sampled").alias("sampled"),
                    F.col("__eased").alias("eased"))


def shares(docs: DataFrame, margins=None, targets=TARGETS, **options) -> DataFrame:
    """(margin, level, target, expected, sampled, eased): of each level the share of
    tokens aimed at, expected by the probabilities, and sampled."""
    m = mixed(docs, margins or default_margins(), targets, **options)
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("margin"), F.col(f"__cell_{x}").alias("level")) for x in targets]))
    t = m.select(cells.alias("c"), "__tokens", (F.col("__tokens") * F.col("__probability")).alias("e"),
                 F.when(F.col("__sampled"), F.col("__tokens")).otherwise(0).alias("s"), "__eased")
    g = t.groupBy("c.margin", "c.level").agg(F.sum("e").alias("e"), F.sum("s").alias("s"), F.max("__eased").alias("eased"))
    every = Window.partitionBy("margin")  # one row per level of the targets
    aim = F.create_map(*[x for k, v in targets.items() for n, share in {**v, OTHER: max(0.0, 1 - sum(v.values()))}.items()
                         for x in (F.lit(f"{k}={n}"), F.lit(float(share)))])
    return g.select("margin", "level", F.element_at(aim, F.concat_ws("=", "margin", "level")).alias("target"),
                    F.try_divide("e", F.sum("e").over(every)).alias("expected"),
                    F.try_divide("s", F.sum("s").over(every)).alias("sampled"), "eased")

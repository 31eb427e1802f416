"""Operator 11, Merkle dataset manifest by a slot pivot.

Each row becomes a leaf, the SHA-256 of its fields, each written as its byte
count and value. Leaves of a group stand in order; every ``fanout`` consecutive
nodes become one parent, the hash of their digests, until one is left, the
group's subroot; the subroots, in the order of their groups, give the root.

Method: a node's place in its group names its parent and its slot. Conditional
aggregates spread the children of a parent into slot columns; concatenated
columns hash the parent, and the columns other than a child's own are its
siblings. One shuffle takes ``height`` levels, as the aggregate has
``fanout ** height`` slot columns and the levels between are columns computed
from them. A second pass goes down from the root and hands each child its
siblings and what its parent was handed, so a leaf ends with its whole proof.

Places come from a range shuffle by group, order and row: a row's place is its
number within its task plus the rows of its group in earlier tasks. No window
holds a group, so a group with most of all rows is spread over all tasks.

Defined cases: a NULL field is hashed as ``-``; a NULL group is a group of its
own and comes first; NULL order values come first; rows with equal order values
stand by their leaves, and whole repeated rows are leaves of their own. The
proof of the only leaf of the only group is empty. Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tipscope.llm.base import maybe_broadcast, stored

#: Fixed value: the columns of a leaf, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Levels that one shuffle takes.
HEIGHT = 4
STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(*[field(c) for c in values])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``p``, the place of a row in its group ``g`` by ``order`` (from 0), and
    ``n``, the rows of the group."""
    keys = [F.col("g"), *[F.col(c).asc_nulls_first() for c in order]]
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    sorted_ = tied.repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")
    r = stored(sorted_.withColumn("__at", F.monotonically_increasing_id()), "merkle-order")
    r = r.withColumn("__task", F.shiftright("__at", 33))
    tasks = r.groupBy("g", "__task").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    group = Window.partitionBy("g")
    before = F.sum("__rows").over(group.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = tasks.select("g", "__task", "__first", F.coalesce(before, F.lit(0)).alias("__before"),
                         F.sum("__rows").over(group).alias("n"))
    return (r.join(maybe_broadcast(tasks, 100_000), ["g", "__task"])
            .withColumn("p", F.col("__before") + F.col("__at") - F.col("__first"))
            .drop("__task", "__at", "__first", "__before"))


def _name(level, k):
    return f"l{level}_{k}"


def pivot(nodes: DataFrame, carried: list[str], fanout: int, height: int) -> DataFrame:
    """Subtrees of ``height`` levels: one row (g, n, b) for each run of
    ``fanout ** height`` nodes, with a struct column ``s<j>`` for each slot and the
    digests ``l<level>_<k>`` of its levels. A level that has one node in the whole
    group is the last: what stands above repeats it."""
    slots = fanout ** height
    pick = [F.max(F.when(F.col("p") % slots == j, F.struct("h", *carried))).alias(f"s{j}") for j in range(slots)]
    t = nodes.groupBy("g", "n", F.floor(F.col("p") / slots).cast("long").alias("b")).agg(*pick)
    t = t.withColumns({_name(0, j): F.col(f"s{j}.h") for j in range(slots)})
    for level in range(height):
        many = F.col("n") > fanout ** level
        new = {}
        for k in range(fanout ** (height - level - 1)):
            run = [F.col(_name(level, k * fanout + i)) for i in range(fanout)]
            new[_name(level + 1, k)] = F.when(many & run[0].isNotNull(), digest(*run)).otherwise(run[0])
        t = t.withColumns(new)
    return t


def unfold(tops: DataFrame, carried: list[str], kept: list[str], fanout: int, height: int) -> DataFrame:
    """The nodes of pivoted rows: place ``p``, digest ``h`` and ``path``, the
    siblings before and after it on each level, then the path of the subtree."""
    levels = sum(F.when(F.col("n") > fanout ** level, 1).otherwise(0) for level in range(height))
    nodes = []
    for j in range(fanout ** height):
        steps = []
        for level in range(height):
            k = j // fanout ** level
            first = k - k % fanout
            run = [F.col(_name(level, first + i)) for i in range(fanout)]
            steps.append(F.struct(F.concat_ws("", F.lit(""), *run[:k - first]).alias("before"),
                                  F.concat_ws("", F.lit(""), *run[k - first + 1:]).alias("after")))
        path = F.concat(F.slice(F.array(*steps), F.lit(1), levels), F.col("path"))
        nodes.append(F.struct((F.col("b") * fanout ** height + j).alias("p"), F.col(f"s{j}.h").alias("h"),
                              *[F.col(f"s{j}.{c}").alias(c) for c in carried],
                              F.when(F.col(f"s{j}").isNotNull(), path).alias("path")))
    return tops.select("g", *kept, F.inline(F.array(*nodes))).where(F.col("h").isNotNull())


def climb(nodes: DataFrame, carried: list[str], fanout=FANOUT, height=HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """The pivoted rows of each round, and (g, h), the last node of each group."""
    rounds = []
    left = nodes.agg(F.max("n")).first()[0] or 0
    while not rounds or left > 1:
        t = stored(pivot(nodes, [] if rounds else carried, fanout, height), f"merkle-{len(rounds)}")
        rounds.append(t)
        nodes = t.select("g", F.ceil(F.col("n") / fanout ** height).cast("long").alias("n"), F.col("b").alias("p"),
                         F.col(_name(height, 0)).alias("h"))
        left = -(-left // fanout ** height)
    return rounds, nodes.select("g", "h")


def descend(rounds: list[DataFrame], tops: DataFrame, carried: list[str], kept: list[str],
            fanout=FANOUT, height=HEIGHT) -> DataFrame:
    """Hand the paths of the groups' last nodes, ``tops`` (g, path, kept), down
    to the leaves."""
    paths = tops.withColumn("p", F.lit(0).cast("long"))
    for i, t in reversed(list(enumerate(rounds))):
        up = paths.select(F.col("g").alias("__g"), F.col("p").alias("__p"), "path", *kept)
        joined = t.join(up, (F.col("g") == F.col("__g")) & (F.col("b") == F.col("__p")))
        paths = unfold(joined, carried if i == 0 else [], kept, fanout, height)
    return paths


def manifest(docs: DataFrame, columns=LEAF_COLUMNS, group_col="lang", order_col="doc_id", carried: dict | None = None,
             fanout=FANOUT, height=HEIGHT) -> DataFrame:
    """One row per input row: ``id`` (the order column), the ``carried`` columns
    (name to Column), ``leaf``, ``subroot``, ``root`` and ``path``, the proof: for
    each level up to the root the digests before and after the row's own node."""
    carried = carried or {}
    group = F.col(f"`{group_col}`").cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("+"), group), F.lit("")).alias("g"),
                       F.col(f"`{order_col}`").alias("id"), leaf([F.col(f"`{c}`") for c in columns]).alias("h"),
                       *[c.alias(k) for k, c in carried.items()])
    names = ["id", *carried]
    rounds, subroots = climb(numbered(stored(rows, "merkle-leaves"), ["id", "h"]), names, fanout, height)
    groups = subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), "h")
    over, root = climb(numbered(groups, ["group"]), ["group"], fanout, height)
    tops = root.select("g", F.col("h").alias("root"), F.array().cast(STEP).alias("path"))
    tops = descend(over, tops, ["group"], ["root"], fanout, height)
    tops = tops.select(F.col("group").alias("g"), F.col("h").alias("subroot"), "root", "path")
    leaves = descend(rounds, tops, names, ["subroot", "root"], fanout, height)
    return leaves.select(*names, F.col("h").alias("leaf"), "subroot", "root", "path")


def fold(path: Column, node: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, node, lambda at, x: F.sha2(F.concat(x["before"], at, x["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""))


def report(docs: DataFrame) -> DataFrame:
    """The query's rows: where 7 divides the CRC-32 of the id, one is added to
    n_chars before the proof is folded. The number is taken as a decimal, so the
    largest long does not overflow."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(21,0)")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(tampered, leaf([more if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS]))
    m = manifest(docs, carried={"changed": changed})
    m = m.withColumn("folded_root", fold(F.col("path"), F.coalesce("changed", "leaf")))
    return m.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

"""Shared helpers: intermediate tables, row keys, native word splitting."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipscope.session import checkpoint_dir

#: What separates words, as a class of a Java regular expression.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ID, HASH = "__llm_id", "__llm_hash"


def ship(name: str) -> None:
    """Send the module's functions to Python workers by value, so executors
    need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def sliced(run, rows=1000):
    """``run`` over Arrow batches, given slices of ``rows`` rows, so that a worker
    holds few texts at a time as Python objects."""
    def go(batches):
        return run(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
    return go


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: later
    steps reuse the rows, and a lost executor rereads files instead of
    recomputing. Row order and generated ids are fixed by the write."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_array(c: Column) -> Column:
    """Words of a text (NULL: none) as an array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add the row key: the id and the text's hash. Rows equal in both get equal
    decisions, so a repeated or NULL id needs no special case."""
    return df.withColumns({ID: F.col(f"`{id_col}`"), HASH: F.xxhash64(F.col(f"`{text_col}`"))})


def join_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the row key, NULL ids matching; the right side has one row a key."""
    r = right.withColumnsRenamed({ID: "__r_id", HASH: "__r_hash"})
    on = left[ID].eqNullSafe(r["__r_id"]) & (left[HASH] == r["__r_hash"])
    return left.join(r, on, how).drop("__r_id", "__r_hash")


def rows_under(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than that."""
    return df.limit(bound + 1).count() <= bound


def maybe_broadcast(df: DataFrame, bound: int) -> DataFrame:
    """A broadcast hint only for a table counted to be within ``bound`` rows; a
    larger one is joined through a shuffle."""
    return F.broadcast(df) if rows_under(df, bound) else df

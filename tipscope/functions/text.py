"""Text and vector column expressions.

Chunking, squishing, truncation and cosine similarity are built-in
string / higher-order array functions, evaluated per row in the JVM.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chunking and preview parameters of the reference
CHUNK_SIZE = 700
CHUNK_OVERLAP = 120
PREVIEW_WIDTH = 250
ELLIPSIS = "..."


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squish(text) -> Column:
    """Trim and collapse every run of (Unicode) whitespace to one space (txt_squish, T16)."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def chunk_starts(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """1-based chunk start positions: one chunk when the text fits, else every
    size - overlap characters (the tail may be short or wholly overlapped)."""
    t = _c(text)
    n = F.length(t)
    return F.when(n <= size, F.array(F.lit(1))).otherwise(
        F.sequence(F.lit(1), n, F.lit(size - overlap)))


def chunks(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of chunks of an already squished text (txt_chunk)."""
    t = _c(text)
    return F.transform(chunk_starts(t, size, overlap), lambda s: F.substring(t, s, size))


def n_chunks(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Number of chunks without materialising them."""
    n = F.length(_c(text))
    return F.when(n <= size, F.lit(1)).otherwise(
        F.floor((n - 1) / (size - overlap)) + 1).cast("long")


def truncate(text, width: int = PREVIEW_WIDTH, ellipsis: str = ELLIPSIS) -> Column:
    """Cut to ``width`` characters including the ellipsis (txt_truncate)."""
    t = _c(text)
    return F.when(F.length(t) > width,
                  F.concat(F.substring(t, 1, width - len(ellipsis)), F.lit(ellipsis))).otherwise(t)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a, b, zero: float | None = 0.0) -> Column:
    """Cosine similarity; a zero-norm side gives ``zero`` (0 as in the test
    script; None keeps NULL where the app would produce NaN) (vec_cosine)."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.coalesce(c, F.lit(zero)) if zero is not None else c


# The 26 letters of the letter-frequency embedding
LETTERS = tuple(string.ascii_lowercase)


def letter_vector(text) -> Column:
    """26-dim letter-count vector of the lower-cased text: a deterministic
    local embedding usable without a model (vec_embed_local, method='letters')."""
    t = F.lower(_c(text))
    return F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))).cast("double")
                     for ch in LETTERS])

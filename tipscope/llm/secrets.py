"""Operator 3, secret scan with corpus-wide ownership frequency. Native: only
DataFrame functions.

Base kinds are three patterns. Beside them, runs of 20 or more key characters
that mix capitals, small letters and digits are candidates. All candidates'
values are hashed and counted over the corpus by distinct repositories and
owners: a value that many owners hold, or that stands in many repositories, is
an example that was copied around; one that a single owner holds in few
repositories looks live, what lies between is shared. A candidate outside the
base kinds is reported (kind ``owned``) unless it is an example or overlaps a
base span. Where the table names no repositories, a document is one.

A pattern's positions come from the text's gaps between matches: the lengths of
gaps and matches, summed up in order, give code-point offsets. ``access`` and
``hex`` have their least length in the pattern, which leaves the same matches,
as a shorter run holds no longer one; ``assign`` is filtered afterwards, as a
dropped match still covers its characters.

Defined cases: a NULL or empty text has no spans; a NULL owner or repository is
an owner or repository of its own; repeated rows are scanned each, and count as
one repository and owner; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipscope.llm.base import stored

#: The kinds in the order of the result, their patterns, the
#: group that holds the value, and its least length.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "owned": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
}
BASE_KINDS = ("assign", "access", "hex")
#: From so many owners, or so many repositories, on, a value is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 10


def _matches(text: Column, kind: str) -> Column:
    """(gap before, match, value) of each match; NULL without any."""
    pattern, group, _ = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.when(text.rlike(pattern), F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), value.alias("value")))
    return F.filter(found, lambda x: x["hit"].isNotNull())


def _spans(scan: DataFrame, kind: str) -> DataFrame:
    """Positions and value hashes of one kind's matches."""
    m = scan.select("rid", "owner", "repo", F.posexplode(kind).alias("i", "m")).select(
        "rid", "owner", "repo", "i", F.col("m.gap").alias("gap"), F.length("m.hit").alias("len"), F.col("m.value").alias("value"))
    upto = Window.partitionBy("rid").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto).cast("long")).where(
        F.length("value") >= KINDS[kind][2])
    if kind == "owned":
        m = m.where(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]"))
    return m.select("rid", "owner", "repo", F.lit(kind).alias("kind"), F.lit(list(KINDS).index(kind)).alias("nth"),
                    (F.col("end") - F.col("len")).alias("start"), "end", F.xxhash64("value").alias("value"))


def ownership(spans: DataFrame) -> DataFrame:
    """(value, owners, repos, rows) of each candidate value. Counted in three
    steps with map-side sums, so a value in a third of all rows is few rows."""
    by_repo = spans.groupBy("value", "owner", "repo").agg(F.count("*").alias("rows"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("rows").alias("rows"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"),
                                         F.sum("rows").alias("rows"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col="doc_id", text_col="text", owner_col="source", repo_cols=("source", "doc_id"),
         example_owners=EXAMPLE_OWNERS, example_repos=EXAMPLE_REPOS) -> DataFrame:
    """One row per input row: doc_id, and ``spans``: all spans by start and
    kind, each with kind, start, end, the owners and repositories of its value,
    and a verdict (live, shared or example)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{owner_col}`").cast("string").alias("owner"),
                       F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in repo_cols])).alias("repo"),
                       *[_matches(text, k).alias(k) for k in KINDS])
    found = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "secret-matches")
    spans = None
    for k in KINDS:
        s = _spans(found, k)
        spans = s if spans is None else spans.unionAll(s)
    spans = stored(spans, "secret-spans")
    judged = spans.join(ownership(spans), "value").withColumn(
        "verdict", F.when((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos), "example")
        .when(F.col("owners") == 1, "live").otherwise("shared"))
    judged = judged.where(F.col("kind").isin(*BASE_KINDS) | (F.col("verdict") != "example"))
    one = F.struct("start", "nth", "kind", "end", "owners", "repos", "verdict")
    per_row = judged.groupBy("rid").agg(F.sort_array(F.collect_list(one)).alias("all"))
    base = F.filter("all", lambda s: s["nth"] < len(BASE_KINDS))
    per_row = per_row.withColumn("base", base).withColumn("spans", F.filter("all", lambda s: (
        s["nth"] < len(BASE_KINDS)) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    none = F.lit(None).cast(per_row.schema["spans"].dataType)
    return found.select("rid", "doc_id").join(per_row.select("rid", "spans"), "rid", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(per_row.schema["spans"].dataType), none).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the base spans' SHA-256 and all spans as text."""
    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def v(name):
        return F.size(F.filter("spans", lambda s: s["verdict"] == name)).cast("long").alias(f"n_{name}")

    base = F.filter("spans", lambda s: s["nth"] < len(BASE_KINDS))
    return scanned.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"),
                          _joined(F.col("spans")).alias("spans"), n("owned"), v("live"), v("shared"), v("example"))

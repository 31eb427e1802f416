"""Documents -> chunk store -> vectors -> top-k -> prompt.

Chunk ids are a global sequence in (document, position) order computed
with a prefix sum over ranges of (document, number of chunks), without the
texts. Retrieval is an exact pruned search (``vector_search``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipscope.functions import text as tx
from tipscope.functions.sizing import broadcast_if_small
from tipscope.operators.ranges import prefix_offsets
from tipscope.operators.vector_search import VectorIndex, build_index, search
from tipscope.sources import files

# Prompt wording of the reference's question-answering step
PROMPT_HEAD = ("Answer the question only using the context below.\n"
               "If the answer is not in the context, say you do not know.\n"
               "Keep the answer short and clear.\n")
CHUNK_SEPARATOR = "\n\n---\n\n"
CONTEXT_TITLE = "Current dashboard filters:"
DASHBOARD_HEAD = "Dashboard context:\n "


def _squished(docs: DataFrame, id_col: str, source_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(row, doc_id, source, text, chunks): squished once and written, so that
    row numbers and counts are fixed and can be read without the texts. A NULL
    text counts as empty and has one empty chunk."""
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("doc_id"),
                    F.col(f"`{source_col}`").alias("source"),
                    tx.squish(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_t"))
    return files.stored(d.withColumn("_nc", tx.n_chunks("_t", size, overlap)), "squished")


def chunk_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = tx.CHUNK_SIZE,
              overlap: int = tx.CHUNK_OVERLAP) -> DataFrame:
    """(chunk_id, doc_id) of every chunk (win_chunk_id): only ids and numbers of
    chunks are shuffled, texts are read once to be measured."""
    text = tx.squish(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), tx.n_chunks(text, size, overlap).alias("_nc"))
    o = prefix_offsets(files.stored(d, "chunk-counts"), "doc_id", "_nc")
    return o.select(F.explode(F.sequence((F.col("_offset") + 1).cast("long"), (F.col("_offset") + F.col("_nc")).cast("long"))).alias("chunk_id"),
                    "doc_id")


def chunk_store(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text", size: int = tx.CHUNK_SIZE,
                overlap: int = tx.CHUNK_OVERLAP) -> DataFrame:
    """(chunk_id, doc_id, source, chunk) for every chunk of every squished
    document, ids in the order of ``id_col`` of any sortable type (txt_chunk_store,
    txt_chunk). The prefix sum runs over ids and counts; its result is joined to
    the texts by row number, which no two rows share; up to a million documents
    (counted) it is broadcast, so the texts are not shuffled. A NULL text counts as
    empty and has one empty chunk; documents of one id follow each other."""
    d = _squished(docs, id_col, source_col, text_col, size, overlap)
    o = prefix_offsets(d.select("doc_id", "_row", "_nc"), ["doc_id", "_row"], "_nc").select("_row", "_offset")
    ex = d.join(broadcast_if_small(o), "_row").select("doc_id", "source", "_offset",
                                  F.posexplode(tx.chunks("_t", size, overlap)).alias("pos", "chunk"))
    return ex.select((F.col("_offset") + F.col("pos") + 1).cast("long").alias("chunk_id"),
                     "doc_id", "source", "chunk")


def join_paragraphs(rows: DataFrame, doc: str, pos: str, text: str,
                    type_col: str | None = None, keep_types: Sequence[str] | None = None,
                    sep: str = "\n") -> DataFrame:
    """Ordered paragraph rows -> one (doc, text) row per document, keeping the
    chosen content types (txt_join_paragraphs). A document's paragraphs form
    one value anyway; the sort is per document."""
    r = rows
    if type_col and keep_types is not None:
        r = r.where(F.col(type_col).isin(list(keep_types)))
    g = r.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"),
                                                               F.col(text).alias("t")))).alias("_ps"))
    return g.select(F.col(doc), F.array_join(F.transform("_ps", lambda s: s["t"]), sep).alias("text"))


def embed_letters(df: DataFrame, text_col: str = "chunk", out: str = "embedding") -> DataFrame:
    """Letter-frequency vectors (vec_embed_local, method='letters')."""
    return df.withColumn(out, tx.letter_vector(text_col))


def _hashed_terms(text_col: str, num_features: int) -> list:
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    return [RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\W+", minTokenLength=1),
            HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)]


def term_counts(df: DataFrame, text_col: str = "chunk", num_features: int = 256) -> DataFrame:
    """``df`` with ``_tf``, the hashed tokens' counts. A corpus stored with it is
    split into tokens once, not by ``hashing_model`` and ``embed_with`` each."""
    from pyspark.ml import PipelineModel
    return PipelineModel(_hashed_terms(text_col, num_features)).transform(df).drop("_tok")


def hashing_model(corpus: DataFrame, text_col: str = "chunk", num_features: int = 256):
    """Token hashing + IDF fitted on the stored texts with Spark ML
    (vec_embed_local, method='hashing'); one distributed pass for the
    document frequencies. Apply it to questions with ``embed_with``."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import IDF

    counted = corpus if "_tf" in corpus.columns else term_counts(corpus, text_col, num_features)
    return PipelineModel([*_hashed_terms(text_col, num_features), IDF(inputCol="_tf", outputCol="_idf").fit(counted)])


def embed_with(model, df: DataFrame, out: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    weigh = model.stages[-1] if "_tf" in df.columns else model
    return (weigh.transform(df).withColumn(out, vector_to_array("_idf", "float64"))
                 .drop("_tok", "_tf", "_idf"))


def embed_hashing(df: DataFrame, text_col: str = "chunk", out: str = "embedding",
                  num_features: int = 256) -> DataFrame:
    """Hashing/IDF vectors fitted on and applied to the same texts."""
    return embed_with(hashing_model(df, text_col, num_features), df, out)


def topk_batch(store: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "chunk_id",
               vec_col: str = "embedding", q_id: str = "query_id", q_vec: str = "query_vec",
               zero: float | None = 0.0, score_places: int | None = 9, index: VectorIndex | None = None) -> DataFrame:
    """Top-k stored rows per query by cosine similarity (vec_topk_batch, vec_topk),
    exact, by a search that skips what cannot win (``vector_search``). ``index`` is
    that of the store where it is kept. The store's columns are joined to the
    hits."""
    index = index or build_index(store, id_col, vec_col)
    hits, _ = search(index, queries, k, q_id, q_vec, zero, score_places)
    hits = hits.withColumnsRenamed({"id": id_col, "q_id": q_id})
    return store.join(broadcast_if_small(hits), id_col)


def centroids(df: DataFrame, vec_col: str = "embedding", keys: Sequence[str] = ()) -> DataFrame:
    """Mean vector per group (or of the whole table): one grouped average per
    (group, position), then each group's positions (a fixed, small count)
    gathered in order. Output: keys + ``centroid``."""
    keys = list(keys)
    x = df.select(*keys, F.posexplode(vec_col).alias("_i", "_v"))
    m = x.groupBy(*keys, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_v"))
    g = m.groupBy(*keys) if keys else m.groupBy()
    return g.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))),
                             lambda t: t["_v"]).alias("centroid"))


def topk_one(store: DataFrame, query_vec: DataFrame, k: int = 3, **kw) -> DataFrame:
    """Top-k for a single query vector (vec_topk); ``query_vec`` has one row."""
    return topk_batch(store, query_vec, k, **kw)


def sources_table(hits: DataFrame, text_col: str = "chunk", id_col: str = "chunk_id",
                  source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """Result table: id, source, score to 4 places, 250-character preview (rag_sources)."""
    return hits.select(*keep, F.col(id_col).alias("chunk_id"), F.col(source_col).alias("source"),
                       (F.round(F.col("score") * 1e4) / 1e4).alias("score"),
                       tx.truncate(text_col).alias("preview"))


def context_text(filtered: DataFrame, months: Sequence, weekdays: Sequence) -> DataFrame:
    """Dashboard filter state as text (txt_context); the row count is
    computed from the filtered table."""
    m = ", ".join(str(x) for x in months)
    w = ", ".join(str(x) for x in weekdays)
    return filtered.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.concat_ws("\n", F.lit(CONTEXT_TITLE), F.lit(f"Months: {m}"),
                    F.lit(f"Pickup weekdays: {w}"),
                    F.concat(F.lit("Filtered rows: "), F.col("n_rows").cast("string")))
        .alias("context"))


def prompts(hits: DataFrame, questions: DataFrame, q_id: str = "query_id",
            q_text: str = "question", context: DataFrame | None = None,
            id_col: str = "chunk_id", source_col: str = "source",
            text_col: str = "chunk") -> DataFrame:
    """One prompt per question: retrieved chunks in score order joined with
    separators inside the fixed instructions (txt_prompt). Each question
    holds at most k hits, so the per-question list is bounded."""
    part = F.concat(F.lit("Chunk "), F.col(id_col).cast("string"), F.lit(" from "),
                    F.col(source_col), F.lit(":\n"), F.col(text_col))
    g = (hits.groupBy(q_id)
             .agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"),
                                                      part.alias("t")))).alias("_p"))
             .select(q_id, F.array_join(F.transform("_p", lambda s: s["t"]), CHUNK_SEPARATOR)
                     .alias("_ctx")))
    q = questions.select(F.col(q_id), F.col(q_text).alias("question"))
    j = q.join(g, q_id, "left")
    if context is not None:
        j = j.crossJoin(F.broadcast(context.select(
            F.concat(F.lit(DASHBOARD_HEAD), F.col("context")).alias("_dash"))))
    else:
        j = j.withColumn("_dash", F.lit(""))
    prompt = F.concat_ws("\n", F.lit(PROMPT_HEAD), F.col("_dash"), F.lit(""), F.lit("Context:"),
                         F.coalesce(F.col("_ctx"), F.lit("")), F.lit(""), F.lit("Question:"),
                         F.col("question"))
    return j.select(q_id, "question", prompt.alias("prompt"))


def retrieve(store: DataFrame, questions: DataFrame, k: int = 3, q_id: str = "query_id",
             q_text: str = "question", q_vec: str = "query_vec",
             context: DataFrame | None = None) -> DataFrame:
    """Questions (with their vectors) -> top-k chunks as ``sources`` (rank
    order: chunk_id, source, score to 4 places) and the assembled prompt
    (rag_retrieve; the model call itself is not made)."""
    hits = topk_batch(store, questions.select(q_id, q_vec), k, q_id=q_id, q_vec=q_vec)
    src = (hits.groupBy(q_id)
               .agg(F.array_sort(F.collect_list(F.struct(
                   "rank", "chunk_id", "source",
                   (F.round(F.col("score") * 1e4) / 1e4).alias("score")))).alias("_s"))
               .select(q_id, F.transform("_s", lambda x: x.dropFields("rank")).alias("sources")))
    p = prompts(hits, questions.select(q_id, q_text), q_id, q_text, context)
    return p.join(src, q_id, "left")

"""Registered text, vector and retrieval queries."""

from pyspark.sql import functions as F

from tipscope.catalog.base import register, table
from tipscope.catalog.basics import CHUNKS_CTE, DASH_DAYS, DASH_MONTHS, RECODE_SQL, _recoded
from tipscope.functions import text as tx
from tipscope.functions.text import LETTERS
from tipscope.functions.sizing import broadcast_if_small
from tipscope.operators import retrieval as rt
from tipscope.operators import vector_search as vs
from tipscope.plans import dashboard as dash
from tipscope.session import app_id
from tipscope.sources import files


def docs(s, d):
    return table(s, d, "documents")


def store(s, d):
    return rt.chunk_store(docs(s, d))


SQUISH = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"

register("txt_squish",
         lambda s, d: docs(s, d).select("doc_id", tx.squish("text").alias("text")),
         f"SELECT doc_id, {SQUISH} AS text FROM documents")

DCHUNKS = """
  SELECT doc_id, source,
         CAST(CASE WHEN length(t) <= 700 THEN 0 ELSE (s - 1) // 580 END AS INTEGER) AS pos,
         substring(t, CAST(s AS BIGINT), 700) AS chunk
  FROM (SELECT doc_id, source, t,
               unnest(CASE WHEN length(t) <= 700 THEN [1]
                           ELSE range(1, length(t) + 1, 580) END) AS s
        FROM (SELECT doc_id, source, """ + SQUISH + """ AS t FROM documents) q1) q2"""

register("txt_chunk",
         lambda s, d: docs(s, d).select(
             "doc_id", F.posexplode(tx.chunks(tx.squish("text"))).alias("pos", "chunk")),
         "SELECT doc_id, pos, chunk FROM dchunks", (), (), {"dchunks": DCHUNKS})

register("txt_chunk_store", store, "SELECT * FROM chunks", (), (), CHUNKS_CTE)
register("win_chunk_id", lambda s, d: rt.chunk_ids(docs(s, d)),
         "SELECT chunk_id, doc_id FROM chunks", (), (), CHUNKS_CTE)

register(
    "txt_join_paragraphs",
    lambda s, d: rt.join_paragraphs(table(s, d, "conversations"), "conv_id", "turn", "text",
                                    "role", ["user"]),
    """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text
       FROM conversations WHERE role = 'user' GROUP BY conv_id""")

register(
    "txt_truncate",
    lambda s, d: docs(s, d).select("doc_id", tx.truncate("text").alias("preview")),
    """SELECT doc_id, CASE WHEN length(text) > 250 THEN substring(text, 1, 247) || '...'
                           ELSE text END AS preview FROM documents""")


def _context(s, d):
    f = dash.filtered(_recoded(s, d), dash.FilterState(DASH_MONTHS, DASH_DAYS))
    return rt.context_text(f, DASH_MONTHS, DASH_DAYS)


register(
    "txt_context", _context,
    f"""SELECT concat_ws(chr(10), 'Current dashboard filters:', 'Months: {", ".join(DASH_MONTHS)}',
                         'Pickup weekdays: {", ".join(DASH_DAYS)}',
                         'Filtered rows: ' || CAST(count(*) AS VARCHAR)) AS context
        FROM recoded WHERE month IN ('Jan', 'Jul', 'Dec')
          AND pickup_weekday_name IN ('Mon', 'Fri', 'Sat')""",
    ["feat"], (), {"recoded": RECODE_SQL})

# ---------------------------------------------------------------- vectors
LETTER_SQL = "[" + ", ".join(
    f"CAST(length(lower({{t}})) - length(replace(lower({{t}}), '{c}', '')) AS DOUBLE)"
    for c in LETTERS) + "]"


def _letters(t):
    return LETTER_SQL.format(t=t)


def _cos_sql(a, b):
    return (f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a}))"
            f" * sqrt(list_dot_product({b}, {b})), 0), 0.0)")


def letter_store(s, d):
    """The chunk store with letter vectors, built once per application and
    kept as parquet (the reference keeps its store on disk and reuses it)."""
    return files.materialized(s, f"letter_store:{d}", lambda: rt.embed_letters(store(s, d)))


def questions(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"),
                                        F.col("text").alias("question"))
    return q.withColumn("query_vec", tx.letter_vector("question"))


register(
    "vec_embed_local",
    lambda s, d: letter_store(s, d).select(
        "chunk_id", F.array_join(F.transform("embedding", lambda x: x.cast("bigint")
                                             .cast("string")), ",").alias("letters")),
    f"""SELECT chunk_id, array_to_string(list_transform({_letters('chunk')},
                                           lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')
               AS letters FROM chunks""", (), (), CHUNKS_CTE)

LSTORE = {**CHUNKS_CTE, "lstore": f"SELECT *, {_letters('chunk')} AS embedding FROM chunks",
          "qs": f"SELECT item_id AS query_id, text AS question, {_letters('text')} AS query_vec"
                " FROM benchmark",
          "hits": f"""SELECT * FROM (
              SELECT l.chunk_id, l.doc_id, l.source, l.chunk, q.query_id,
                     round({_cos_sql('q.query_vec', 'l.embedding')}, 9) AS score,
                     row_number() OVER (PARTITION BY q.query_id ORDER BY
                        round({_cos_sql('q.query_vec', 'l.embedding')}, 9) DESC, l.chunk_id) AS rank
              FROM lstore l, qs q) t WHERE rank <= 3"""}


_INDEXES: dict[tuple[str, str], vs.VectorIndex] = {}


def letter_index(s, d):
    """The search index of the letter store, built once per application like it."""
    key = (app_id(s), d)
    if key not in _INDEXES:
        _INDEXES[key] = vs.build_index(letter_store(s, d))
    return _INDEXES[key]


def _hits(s, d):
    return rt.topk_batch(letter_store(s, d), questions(s, d), 3, index=letter_index(s, d))


register("vec_topk_batch",
         lambda s, d: _hits(s, d).select("query_id", "chunk_id", "doc_id", "score", "rank"),
         "SELECT query_id, chunk_id, doc_id, score, rank FROM hits", (), ["score"], LSTORE)

register("rag_sources",
         lambda s, d: rt.sources_table(_hits(s, d), keep=["query_id"]),
         """SELECT query_id, chunk_id, source, round(score, 4) AS score,
                   CASE WHEN length(chunk) > 250 THEN substring(chunk, 1, 247) || '...'
                        ELSE chunk END AS preview FROM hits""", (), ["score"], LSTORE)

PROMPT_SQL = """
SELECT q.query_id, q.question,
       concat_ws(chr(10), 'Answer the question only using the context below.',
                 'If the answer is not in the context, say you do not know.',
                 'Keep the answer short and clear.', '', '', '', 'Context:',
                 coalesce(c.ctx, ''), '', 'Question:', q.question) AS prompt
FROM qs q LEFT JOIN (
  SELECT query_id, string_agg('Chunk ' || CAST(chunk_id AS VARCHAR) || ' from ' || source
                              || ':' || chr(10) || chunk,
                              chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)
           AS ctx
  FROM hits GROUP BY query_id) c ON q.query_id = c.query_id"""

register("txt_prompt",
         lambda s, d: rt.prompts(_hits(s, d), questions(s, d)),
         PROMPT_SQL, (), (), LSTORE)


def global_centroid(s, d):
    """The mean of all stored vectors: the query of the single-query lookups."""
    return rt.centroids(table(s, d, "embeddings"))


GCENT_SQL = """
  SELECT list(v ORDER BY i) AS centroid FROM (
    SELECT i, avg(CAST(v AS DOUBLE)) AS v FROM (
      SELECT unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) x
    GROUP BY i) y"""


def _vec_one(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", "embedding")
    q = global_centroid(s, d).select(F.lit(0).cast("long").alias("query_id"),
                                     F.col("centroid").alias("query_vec"))
    return rt.topk_one(e, q, 3).select("query_id", "chunk_id", "label", "score", "rank")


register(
    "vec_topk", _vec_one,
    f"""SELECT * FROM (
          SELECT CAST(0 AS BIGINT) AS query_id, e.vec_id AS chunk_id, e.label,
                 round({_cos_sql('q.centroid', 'CAST(e.embedding AS DOUBLE[])')}, 9) AS score,
                 row_number() OVER (ORDER BY round({_cos_sql('q.centroid',
                                                             'CAST(e.embedding AS DOUBLE[])')}, 9)
                                    DESC, e.vec_id) AS rank
          FROM embeddings e, gcent q) t
        WHERE rank <= 3""", (), ["score"], {"gcent": GCENT_SQL})


def _centroids(e):
    return rt.centroids(e, "embedding", ["label"])


def _vec_cosine(s, d):
    e = table(s, d, "embeddings")
    c = _centroids(e)
    return (e.join(broadcast_if_small(c, 100_000), "label")
             .select("vec_id", "label", tx.cosine("embedding", "centroid").alias("cosine")))


CENTROID_SQL = """
  SELECT label, list(v ORDER BY i) AS centroid FROM (
    SELECT label, i, avg(CAST(v AS DOUBLE)) AS v FROM (
      SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) x
    GROUP BY label, i) y GROUP BY label"""

register(
    "vec_cosine", _vec_cosine,
    f"""SELECT e.vec_id, e.label,
               {_cos_sql('CAST(e.embedding AS DOUBLE[])', 'c.centroid')} AS cosine
        FROM embeddings e JOIN cent c ON e.label = c.label""", (), ["cosine"],
    {"cent": CENTROID_SQL})


def _label_hits(s, d):
    e = table(s, d, "embeddings")
    q = _centroids(e).select(F.col("label").alias("query_id"), F.col("centroid").alias("query_vec"))
    st = e.select(F.col("vec_id").alias("chunk_id"), "label", "embedding")
    return rt.topk_batch(st, q, 3).select("query_id", "chunk_id", "label", "score", "rank")


register(
    "vec_topk_centroids", _label_hits,
    f"""SELECT * FROM (
          SELECT c.label AS query_id, e.vec_id AS chunk_id, e.label,
                 round({_cos_sql('c.centroid', 'CAST(e.embedding AS DOUBLE[])')}, 9) AS score,
                 row_number() OVER (PARTITION BY c.label ORDER BY
                    round({_cos_sql('c.centroid', 'CAST(e.embedding AS DOUBLE[])')}, 9) DESC,
                    e.vec_id) AS rank
          FROM embeddings e, cent c) t WHERE rank <= 3""", (), ["score"], {"cent": CENTROID_SQL})


def _hashed(s, d):
    """The chunk store with hashing/IDF vectors, and the fitted model. The store
    keeps the hashed tokens' counts."""
    st = files.materialized(s, f"hashed_chunks:{d}", lambda: rt.term_counts(store(s, d)))
    model = rt.hashing_model(st, "chunk")
    return rt.embed_with(model, st), model


def _rag_retrieve(s, d):
    """Question + dashboard context -> top-3 sources and the prompt, with
    hashing/IDF vectors fitted on the chunk store (no model call)."""
    vecs, model = _hashed(s, d)
    qs = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"),
                                         F.col("text").alias("chunk"))
    qv = rt.embed_with(model, qs, "query_vec").withColumnRenamed("chunk", "question")
    out = rt.retrieve(vecs, qv, 3, context=_context(s, d))
    said = F.transform("sources", lambda x: F.concat_ws("|", x["chunk_id"].cast("string"), x["source"],
                                                        x["score"].cast("decimal(8,4)").cast("string")))
    return out.withColumn("sources", F.array_join(said, "; "))


# 32-bit murmur3 of a token's UTF-8 bytes with seed 42, as Spark ML hashes terms
_M = "4294967296::UBIGINT"


def _rotl(x, r):
    return f"((({x}) << {r}) % {_M} + (({x}) >> {32 - r}))"


def _mix_k(k):
    return f"(({_rotl(f'((({k}) * 3432918353::UBIGINT) % {_M})', 15)} * 461845907::UBIGINT) % {_M})"


def _mix_h(h, k):
    return f"((({_rotl(f'xor({h}, {_mix_k(k)})', 13)}) * 5::UBIGINT + 3864292196::UBIGINT) % {_M})"


def _shift(h, r):
    return f"xor({h}, ({h}) >> {r})"


def _bytes(i, n):
    return " + ".join(f"(bs[{i} + {j + 1}] << {8 * j})" for j in range(n))


HASH_CTES = {
    "corpus": "SELECT 'c' AS kind, chunk_id AS id, chunk AS t FROM chunks UNION ALL SELECT 'q', item_id, text FROM benchmark",
    "toks": "SELECT kind, id, unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) AS tok FROM corpus",
    "raw": "SELECT tok, list_transform(range(octet_length(encode(tok))), lambda i: CAST(ascii(substring(tok, CAST(i + 1 AS BIGINT), 1))"
           " AS UBIGINT)) AS bs FROM (SELECT DISTINCT tok FROM toks) q",
    "body": f"""SELECT tok, bs, len(bs) AS n, list_reduce(list_prepend(42::UBIGINT, list_transform(range(len(bs) // 4),
                  lambda k: {_bytes('4 * k', 4)})), lambda h, k: {_mix_h('h', 'k')}) AS h FROM raw""",
    "tailed": f"""SELECT tok, n, CASE n % 4 WHEN 0 THEN h WHEN 1 THEN xor(h, {_mix_k(_bytes('n - 1', 1))})
                    WHEN 2 THEN xor(h, {_mix_k(_bytes('n - 2', 2))}) ELSE xor(h, {_mix_k(_bytes('n - 3', 3))}) END AS h FROM body""",
    "f1": "SELECT tok, " + _shift("xor(h, n::UBIGINT)", 16) + " AS h FROM tailed",
    "f2": f"SELECT tok, {_shift(f'((h * 2246822507::UBIGINT) % {_M})', 13)} AS h FROM f1",
    "f3": f"SELECT tok, {_shift(f'((h * 3266489909::UBIGINT) % {_M})', 16)} % 256 AS bucket FROM f2",
    "tf": "SELECT kind, id, bucket, count(*) AS tf FROM toks t JOIN f3 ON t.tok = f3.tok GROUP BY 1, 2, 3",
    "idf": "SELECT bucket, ln(((SELECT count(*) FROM chunks) + 1.0) / (count(*) + 1.0)) AS idf FROM tf WHERE kind = 'c' GROUP BY 1",
    # a bucket that no chunk has: its document frequency is 0
    "weights": "SELECT kind, id, t.bucket, tf * coalesce(idf, ln((SELECT count(*) FROM chunks) + 1.0)) AS w FROM tf t LEFT JOIN idf i ON t.bucket = i.bucket",
    "norms": "SELECT kind, id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY 1, 2",
    "dots": "SELECT q.id AS query_id, c.id AS chunk_id, sum(q.w * c.w) AS dot FROM weights q JOIN weights c ON q.bucket = c.bucket "
            "WHERE q.kind = 'q' AND c.kind = 'c' GROUP BY 1, 2",
    "scores": "SELECT q.item_id AS query_id, c.chunk_id, c.source, c.chunk, round(coalesce(dot / nullif(qn.norm * cn.norm, 0), 0.0), 9) AS score "
              "FROM benchmark q CROSS JOIN chunks c LEFT JOIN dots d ON d.query_id = q.item_id AND d.chunk_id = c.chunk_id "
              "LEFT JOIN norms qn ON qn.kind = 'q' AND qn.id = q.item_id LEFT JOIN norms cn ON cn.kind = 'c' AND cn.id = c.chunk_id",
    "hhits": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores) t WHERE rank <= 3"}

register("vec_embed_hashing",
         lambda s, d: _hashed(s, d)[0].select(
             "chunk_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n_buckets"),
             F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"), tx.norm("embedding").alias("length"),
             F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x).alias("place_total")),
         """SELECT c.chunk_id, count(*) FILTER (w <> 0) AS n_buckets, coalesce(sum(w), 0.0) AS total,
                   coalesce(sqrt(sum(w * w)), 0.0) AS length, coalesce(sum(w * (bucket + 1)), 0.0) AS place_total
            FROM chunks c LEFT JOIN weights w ON w.kind = 'c' AND w.id = c.chunk_id GROUP BY c.chunk_id""",
         (), ["total", "length", "place_total"], {**CHUNKS_CTE, **HASH_CTES})

RAG_SQL = """
SELECT q.item_id AS query_id, q.text AS question,
       concat_ws(chr(10), 'Answer the question only using the context below.',
                 'If the answer is not in the context, say you do not know.',
                 'Keep the answer short and clear.', '', 'Dashboard context:' || chr(10) || ' ' || (SELECT context FROM dash), '',
                 'Context:', coalesce(c.ctx, ''), '', 'Question:', q.text) AS prompt, c.sources
FROM benchmark q LEFT JOIN (
  SELECT query_id, string_agg('Chunk ' || CAST(chunk_id AS VARCHAR) || ' from ' || source || ':' || chr(10) || chunk,
                              chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS ctx,
         string_agg(CAST(chunk_id AS VARCHAR) || '|' || source || '|' || CAST(CAST(round(score, 4) AS DECIMAL(8,4)) AS VARCHAR),
                    '; ' ORDER BY rank) AS sources
  FROM hhits GROUP BY query_id) c ON q.item_id = c.query_id"""
register("rag_retrieve", _rag_retrieve, RAG_SQL, ["feat"], (),
         {**CHUNKS_CTE, **HASH_CTES, "recoded": RECODE_SQL, "dash": f"""
          SELECT concat_ws(chr(10), 'Current dashboard filters:', 'Months: {", ".join(DASH_MONTHS)}',
                           'Pickup weekdays: {", ".join(DASH_DAYS)}', 'Filtered rows: ' || CAST(count(*) AS VARCHAR)) AS context
          FROM recoded WHERE month IN ('Jan', 'Jul', 'Dec') AND pickup_weekday_name IN ('Mon', 'Fri', 'Sat')"""})

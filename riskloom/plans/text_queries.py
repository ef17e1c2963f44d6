"""Registered text preparation, context documents and vector retrieval."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskloom.functions import text, vector
from riskloom.operators import ann, context, embedding, embedding_state, hyperplanes, integrity, query_tables, similarity, word_index
from riskloom.plans import bindings as b
from riskloom.plans.registry import query
from riskloom.session import scratch_path

WIDTH = 64


@query("event_text", """
SELECT id, concat_ws(' | ', nullif(company_name, ''), nullif(action_name, ''),
       left(nullif(subcategory, ''), 200), 'Date: ' || CAST(announcement_date AS VARCHAR),
       'Sector: ' || nullif(sector, ''), 'Country: ' || nullif(industry, '')) AS text
FROM undated LEFT JOIN described USING (u3_company_number)
""")
def event_text(spark, sf):
    joined = b.undated_events(spark, sf).join(
        b.companies_described(spark, sf).select("u3_company_number", "company_name", "sector", "industry"),
        "u3_company_number", "left",
    )
    return joined.select("id", text.event_text(
        F.col("company_name"), F.col("action_name"), F.col("subcategory"), F.col("announcement_date"),
        F.col("sector"), F.col("industry"),
    ).alias("text"))


@query("event_text_labeled", """
SELECT id, 'Event Type: ' || action_name || ' | Date: ' || coalesce(CAST(announcement_date AS VARCHAR), '')
  || ' | Company: ' || coalesce(company_name, '') || ' | Rating:  | Description: ' || coalesce(subcategory, '') AS text
FROM undated LEFT JOIN companies USING (u3_company_number)
""")
def event_text_labeled(spark, sf):
    joined = b.undated_events(spark, sf).join(
        b.companies(spark, sf).select("u3_company_number", "company_name"), "u3_company_number", "left"
    )
    return joined.select("id", text.event_text_labelled(
        F.col("action_name"), F.col("announcement_date"), F.col("company_name"),
        description=F.col("subcategory"),
    ).alias("text"))


@query("company_text", """
SELECT u3_company_number, 'Company: ' || company_name || ' | Ticker: ' || ticker || ' | Industry: '
  || coalesce(industry, '') || ' | Sector: ' || coalesce(sector, '') || ' | Description: '
  || CASE WHEN market_status = 'BUILDING' THEN ' | Market Cap: ' || ticker ELSE '' END AS text
FROM described
""")
def company_text(spark, sf):
    return b.companies_described(spark, sf).select("u3_company_number", text.company_text(
        F.col("company_name"), F.col("ticker"), F.col("industry"), F.col("sector"),
        market_cap=F.when(F.col("market_status") == "BUILDING", F.col("ticker")),
    ).alias("text"))


@query("text_min_length", """
SELECT count(*) FILTER (WHERE length(text) >= 10) AS processed,
       count(*) FILTER (WHERE length(text) < 10) AS skipped, count(*) AS total FROM documents
""")
def text_min_length(spark, sf):
    return embedding.text_counters(b.table(spark, sf, "documents"), "text")


_OWN = """'## Relevant Companies:' || chr(10) || chr(10) || '- ' || company_name || ' (' || ticker || ')' || chr(10)
  || '  Sector: ' || coalesce(sector, 'N/A') || chr(10) || '  Industry: ' || coalesce(industry, 'N/A')"""
_EVENT = """'- Date: ' || coalesce(CAST(announcement_date AS VARCHAR), 'None') || chr(10)
  || '  Type: ' || action_name || chr(10) || '  Company ID: ' || u3_company_number"""
_EVENTS_HEAD = "chr(10) || '## Relevant Credit Events:' || chr(10) || chr(10)"
_PAGES_SQL = f"""pages AS (
  SELECT u3_company_number, pos // 10 AS page_no, count(*) AS n_events,
         string_agg({_EVENT}, chr(10) || chr(10) ORDER BY pos) AS blocks
  FROM numbered GROUP BY 1, 2
)
SELECT u3_company_number, CAST(coalesce(page_no, 0) AS BIGINT) AS page_no, coalesce(n_events, 0) AS n_events,
  CASE WHEN coalesce(page_no, 0) = 0 THEN {_OWN} || coalesce(chr(10) || chr(10) || {_EVENTS_HEAD} || blocks, '')
       ELSE {_EVENTS_HEAD} || blocks END AS context
FROM described LEFT JOIN pages USING (u3_company_number)"""


@query("company_context", f"""
WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY u3_company_number
           ORDER BY announcement_date DESC NULLS FIRST, id) - 1 AS pos
  FROM undated
), {_PAGES_SQL}
""")
def company_context(spark, sf):
    return context.company_context(b.companies_described(spark, sf), b.undated_events(spark, sf), page_size=10)


@query("company_profile", f"""
WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY u3_company_number ORDER BY announcement_date NULLS LAST, id) - 1 AS pos
  FROM undated
), {_PAGES_SQL}
""")
def company_profile(spark, sf):
    return context.company_profile(b.companies_described(spark, sf), b.undated_events(spark, sf), page_size=10)


@query("pending_embeddings", """
SELECT doc_id, text FROM documents ANTI JOIN labels USING (doc_id)
""")
def pending_embeddings(spark, sf):
    documents = b.table(spark, sf, "documents").select("doc_id", "text")
    return integrity.pending(documents, b.table(spark, sf, "labels"), "doc_id")


def _query_vectors(n: int) -> dict[int, list[float]]:
    """Query vectors by a rule, as a caller would pass the vectors of query texts."""
    return {q: [math.sin((q + 1) * (i + 1)) for i in range(WIDTH)] for q in range(n)}


def _vector_sql(n: int) -> str:
    return (
        f"SELECT q AS query_id, list_transform(range({WIDTH}), lambda i: sin((q + 1) * (i + 1))) AS v "
        f"FROM range({n}) AS t(q)"
    )


def _topk_sql(n: int, k: int, where: str = "", extra: str = "") -> str:
    return f"""
SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank{extra} FROM (
  SELECT query_id, vec_id, similarity, CAST(row_number() OVER (
           PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank
  FROM (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS similarity
        FROM embeddings, ({_vector_sql(n)}) {where}))
WHERE rank <= {k}"""


def _rounded(df):
    return df.withColumn("similarity", F.round("similarity", 6))


@query("cosine_pairs", """
SELECT a.vec_id, b.vec_id AS next_id,
       round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def cosine_pairs(spark, sf):
    e = b.table(spark, sf, "embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"),
                         F.col("embedding").alias("next_embedding"))
    return e.join(following, "vec_id").select(
        "vec_id", "next_id",
        F.round(vector.cosine(F.col("embedding"), F.col("next_embedding")), 6).alias("similarity"),
    )


@query("vector_topk", _topk_sql(5, 10))
def vector_topk(spark, sf):
    items = b.table(spark, sf, "embeddings")
    return _rounded(similarity.search(items, _query_vectors(5), 10, id_col="vec_id"))


@query("vector_topk_filtered", _topk_sql(5, 10, where="WHERE label = 3"))
def vector_topk_filtered(spark, sf):
    items = b.table(spark, sf, "embeddings")
    return _rounded(similarity.search(items, _query_vectors(5), 10, id_col="vec_id", filters={"label": 3}))


@query("hybrid_search", _topk_sql(3, 5, "WHERE label < 5", ", 'company' AS entity") + "\nUNION ALL "
       + _topk_sql(3, 5, "WHERE label >= 5", ", 'event' AS entity"))
def hybrid_search(spark, sf):
    items = b.table(spark, sf, "embeddings")
    kinds = {"company": items.filter("label < 5"), "event": items.filter("label >= 5")}
    return _rounded(similarity.hybrid_search(kinds, _query_vectors(3), 5, id_col="vec_id"))


@query("similar_items", """
SELECT vec_id, neighbour_id, round(similarity, 6) AS similarity, rank FROM (
  SELECT a.vec_id, b.vec_id AS neighbour_id, similarity, CAST(row_number() OVER (
           PARTITION BY a.vec_id ORDER BY similarity DESC, b.vec_id) AS INTEGER) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id,
  LATERAL (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity)
) WHERE rank <= 5
""")
def similar_items(spark, sf):
    items = b.table(spark, sf, "embeddings")
    return _rounded(similarity.similar_items(items, 5, id_col="vec_id", cells=4, block_rows=256))


TABLES, BITS, PROBES = 24, 12, 100


def _asked(spark, sf):
    """Every twentieth vector of the table asks for its neighbours among all."""
    return b.table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _index(spark, sf):
    path = scratch_path(spark, "hash-tables")
    hyperplanes.build_index(b.table(spark, sf, "embeddings"), path, tables=TABLES, bits=BITS, id_col="vec_id")
    return path


@query("ann_topk", f"""
WITH unit AS (
  SELECT vec_id, [x / len for x in v] AS v
  FROM (SELECT vec_id, v, sqrt(list_sum([x * x for x in v])) AS len
        FROM (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings)) WHERE len > 0
), planes AS (
  SELECT p, [CASE WHEN sin(d * d * (t + 1) * 0.7::DOUBLE + d * (t + 1) * 1.3::DOUBLE) > 0 THEN 1 ELSE -1 END
             * cos(pi() * (2 * d - 1) * ((j * 5 + t) % {WIDTH}) / {2 * WIDTH}.0::DOUBLE) for d in range(1, {WIDTH} + 1)] AS plane
  FROM (SELECT p, (p - 1) // {BITS} AS t, (p - 1) % {BITS} AS j FROM (SELECT unnest(range(1, {TABLES * BITS} + 1)) AS p))
), products AS (
  SELECT vec_id, (p - 1) // {BITS} AS tab, list(list_dot_product(v, plane) ORDER BY p) AS m
  FROM unit, planes GROUP BY vec_id, tab
), hashed AS (
  SELECT vec_id, tab, m, CAST(list_sum([CASE WHEN m[j + 1] > 0 THEN 1 << j ELSE 0 END for j in range({BITS})]) AS INTEGER) AS bucket
  FROM products
), probed AS (
  SELECT vec_id AS query_id, tab, xor(bucket, cell) AS bucket FROM (
    SELECT vec_id, tab, bucket, cell, row_number() OVER (PARTITION BY vec_id, tab ORDER BY cost, cell) AS nth FROM (
      SELECT vec_id, tab, bucket, cell,
             list_sum([CASE WHEN (cell >> j) & 1 = 1 THEN m[j + 1] * m[j + 1] ELSE 0 END for j in range({BITS})]) AS cost
      FROM hashed, (SELECT CAST(unnest(range({1 << BITS})) AS INTEGER) AS cell) WHERE vec_id % 20 = 0))
  WHERE nth <= {PROBES}
), read AS (
  SELECT query_id, vec_id, count(*) AS times FROM probed JOIN hashed USING (tab, bucket) GROUP BY 1, 2
)
SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank, comparisons FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank
  FROM (SELECT query_id, r.vec_id, CAST(sum(times) OVER (PARTITION BY query_id) AS BIGINT) AS comparisons,
               round(list_dot_product(q.v, i.v), 12) AS similarity
        FROM read r JOIN unit q ON q.vec_id = query_id JOIN unit i ON i.vec_id = r.vec_id))
WHERE rank <= 10
""")
def ann_topk(spark, sf):
    """Hash tables: the SQL probes the same buckets."""
    found = hyperplanes.search(spark, _index(spark, sf), _asked(spark, sf), 10, probes=PROBES, bits=BITS, id_col="vec_id")
    return _rounded(found)


def _written(df, label):
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _measured(spark, sf):
    """Hits of the hash tables against those of all rows, and the rows read per query."""
    items, asked, path = b.table(spark, sf, "embeddings"), _asked(spark, sf), _index(spark, sf)
    found = hyperplanes.search(spark, path, asked, 10, probes=PROBES, bits=BITS, id_col="vec_id")
    # Both are used twice below.
    exact = _written(query_tables.search_table(items, asked, 10, id_col="vec_id"), "exact-hits")
    read = _written(hyperplanes.rows_read(spark, path, asked, probes=PROBES, bits=BITS), "rows-read")
    everything = items.agg(F.count(F.lit(1))).scalar()
    return ann.recall(found, exact, "vec_id").select(
        "*", read.agg(F.count(F.lit(1))).scalar().alias("queries"), (read.agg(F.avg("rows_read")).scalar() / everything).alias("share_read")
    )


@query("ann_recall")
def ann_recall(spark, sf):
    """Recall of the hash tables and the share of all rows that a query was compared with."""
    return _measured(spark, sf)


@query("ann_promise", """
SELECT count(*) FILTER (WHERE vec_id % 20 = 0) AS queries, true AS nine_tenths_found, true AS under_half_read FROM embeddings
""")
def ann_promise(spark, sf):
    return _measured(spark, sf).select(
        "queries", (F.col("recall") >= 0.9).alias("nine_tenths_found"), (F.col("share_read") < 0.5).alias("under_half_read")
    )


@query("vector_topk_table", """
SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (
  SELECT query_id, vec_id, similarity, CAST(row_number() OVER (
           PARTITION BY query_id ORDER BY round(similarity, 12) DESC, vec_id) AS INTEGER) AS rank
  FROM (SELECT q.vec_id AS query_id, i.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS similarity
        FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0))
WHERE rank <= 10
""")
def vector_topk_table(spark, sf):
    """Queries are rows of the table; nothing of them goes through the driver."""
    items = b.table(spark, sf, "embeddings")
    return _rounded(query_tables.search_table(items, _asked(spark, sf), 10, id_col="vec_id", cells=8, block_rows=256))


def _hashed_sql(source: str, key: str) -> str:
    """Places and weights of the hashed words of texts, as a table body."""
    return f"""
  SELECT {key}, place, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS weight FROM (
    SELECT {key}, CAST(concat('0x', md5(word)[1:8]) AS BIGINT) % 1024 AS place, count(*)::DOUBLE AS n
    FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS word
          FROM {source} WHERE length(text) >= 10)
    GROUP BY 1, 2)"""


@query("embed_hashing", f"""
SELECT doc_id, CAST(place AS INTEGER) AS place, round(weight::DOUBLE, 6) AS weight
FROM ({_hashed_sql("documents", "doc_id")})
""")
def embed_hashing(spark, sf):
    """The filled places of every document's vector."""
    made = embedding.embed_by_hashing(b.table(spark, sf, "documents"), id_col="doc_id")
    return made.select("doc_id", F.posexplode("embedding").alias("place", "weight")).filter("weight <> 0").select(
        "doc_id", "place", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@query("hybrid_sources", f"""
WITH hits AS (
  {_topk_sql(3, 5, "WHERE label < 5", ", 'company' AS entity")}
  UNION ALL {_topk_sql(3, 5, "WHERE label >= 5", ", 'event' AS entity")}
)
SELECT query_id, entity, rank, vec_id, company_name AS name, ticker AS detail
FROM hits JOIN companies ON vec_id = u3_company_number WHERE entity = 'company'
UNION ALL
SELECT query_id, entity, rank, vec_id, action_name, CAST(announcement_date AS VARCHAR)
FROM hits JOIN credit_events ON vec_id = id WHERE entity = 'event'
""")
def hybrid_sources(spark, sf):
    items = b.table(spark, sf, "embeddings")
    kinds = {"company": items.filter("label < 5"), "event": items.filter("label >= 5")}
    hits = similarity.hybrid_search(kinds, _query_vectors(3), 5, id_col="vec_id")
    return similarity.sources(hits, b.companies(spark, sf), b.credit_events(spark, sf), id_col="vec_id")


@query("event_search", f"""
SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity, action_name AS event_type,
       CAST(announcement_date AS VARCHAR) AS announcement_date, company_name, ticker
FROM ({_topk_sql(3, 10, "WHERE label >= 5")}) JOIN credit_events ON vec_id = id JOIN companies USING (u3_company_number)
""")
def event_search(spark, sf):
    events = b.credit_events(spark, sf).join(b.companies(spark, sf), "u3_company_number").select(
        F.col("id").alias("vec_id"), F.col("action_name").alias("event_type"),
        F.col("announcement_date").cast("string").alias("announcement_date"), "company_name", "ticker",
    )
    items = b.table(spark, sf, "embeddings").filter("label >= 5")
    hits = similarity.search(items, _query_vectors(3), 10, id_col="vec_id")
    return _rounded(similarity.with_attributes(hits, events, "vec_id"))


_COMPANY_LINES = """'- ' || company_name || ' (' || ticker || ')' || chr(10) || '  Sector: '
  || coalesce(sector, 'N/A') || chr(10) || '  Industry: ' || coalesce(industry, 'N/A')"""


@query("query_context", f"""
WITH company_hits AS (
  SELECT query_id, string_agg({_COMPANY_LINES}, chr(10) || chr(10) ORDER BY rank) AS blocks
  FROM ({_topk_sql(4, 5, "WHERE label < 5")}) JOIN described ON vec_id = u3_company_number GROUP BY 1
), event_hits AS (
  SELECT query_id, string_agg({_EVENT}, chr(10) || chr(10) ORDER BY rank) AS blocks
  FROM ({_topk_sql(4, 5, "WHERE label >= 5")}) JOIN undated ON vec_id = id GROUP BY 1
)
SELECT q AS query_id, coalesce(nullif(concat_ws(chr(10) || chr(10),
  '## Relevant Companies:' || chr(10) || chr(10) || c.blocks, {_EVENTS_HEAD} || e.blocks), ''),
  'No relevant data found.') AS context
FROM range(4) AS t(q) LEFT JOIN company_hits c ON q = c.query_id LEFT JOIN event_hits e ON q = e.query_id
""")
def query_context(spark, sf):
    items = b.table(spark, sf, "embeddings")
    kinds = {"company": items.filter("label < 5"), "event": items.filter("label >= 5")}
    hits = similarity.hybrid_search(kinds, _query_vectors(4), 5, id_col="vec_id")
    return context.query_context(hits, b.companies_described(spark, sf), b.undated_events(spark, sf), "vec_id")


@query("company_children", """
SELECT u3_company_number, CAST(pos // 10 AS BIGINT) AS page_no, count(*) AS n_events,
       min_by(id, pos) AS first_id, max_by(id, pos) AS last_id, max_by(action_name, pos) AS last_action
FROM (SELECT *, row_number() OVER (PARTITION BY u3_company_number ORDER BY announcement_date NULLS LAST, id) - 1 AS pos
      FROM undated) GROUP BY 1, 2
""")
def company_children(spark, sf):
    pages = context.event_children(b.undated_events(spark, sf), page_size=10)
    first, last = F.element_at("events", 1), F.element_at("events", -1)
    return pages.select(
        "u3_company_number", "page_no", F.size("events").cast("long").alias("n_events"),
        first["id"].alias("first_id"), last["id"].alias("last_id"), last["action_name"].alias("last_action"),
    )


TEXTS = {1: "the license of this document", 2: "copyright and all rights reserved"}


@query("text_search", f"""
WITH asked(query_id, text) AS (VALUES {", ".join(f"({q}::BIGINT, '{t}')" for q, t in TEXTS.items())}),
d AS ({_hashed_sql("documents", "doc_id")}),
q AS ({_hashed_sql("asked", "query_id")}),
lengths AS (SELECT doc_id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS length FROM d GROUP BY 1),
asked_lengths AS (SELECT query_id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS length FROM q GROUP BY 1),
dots AS (
  SELECT query_id, doc_id, sum(d.weight::DOUBLE * q.weight::DOUBLE) AS dot FROM d JOIN q USING (place) GROUP BY 1, 2
)
SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM (
  SELECT query_id, doc_id AS id, similarity, CAST(row_number() OVER (
           PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS INTEGER) AS rank
  FROM (SELECT a.query_id, l.doc_id, round(coalesce(dot, 0) / (a.length * l.length), 12) AS similarity
        FROM asked_lengths a CROSS JOIN lengths l
        LEFT JOIN dots USING (query_id, doc_id))
) WHERE rank <= 10
""")
def text_search(spark, sf):
    """Texts are indexed once; the search reads the lists of its words, and no dense vectors."""
    documents = b.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    index = scratch_path(spark, "word-index")
    word_index.build_index(documents, index)
    return _rounded(word_index.search(spark, index, spark.createDataFrame(list(TEXTS.items()), "query_id long, text string"), 10))


@query("text_index", f"""
SELECT CAST(place AS INTEGER) AS place, count(*) AS entries, round(max(share), 6) AS most
FROM (SELECT place, weight::DOUBLE / sqrt(sum(weight::DOUBLE * weight::DOUBLE) OVER (PARTITION BY doc_id)) AS share
      FROM ({_hashed_sql("documents", "doc_id")})) GROUP BY place
""")
def text_index(spark, sf):
    """Building the index alone: its lists and their bounds."""
    index = scratch_path(spark, "word-index")
    word_index.build_index(b.table(spark, sf, "documents"), index, id_col="doc_id")
    return spark.read.parquet(f"{index}/bounds").select("place", "entries", F.round("most", 6).alias("most"))


def _letter_shares(texts: list[str]) -> list[list[float]]:
    """A small embedding function as a caller would bring it: shares of five vowels."""
    return [[t.count(v) / len(t) for v in "aeiou"] for t in texts]


@query("embed_custom", """
SELECT doc_id, 'vowels' AS embedding_model, length(text) AS n_chars,
       round(CAST((length(text) - length(replace(text, 'a', ''))) / length(text) AS FLOAT)::DOUBLE, 6) AS share_a,
       round(CAST((length(text) - length(replace(text, 'u', ''))) / length(text) AS FLOAT)::DOUBLE, 6) AS share_u
FROM documents WHERE length(text) >= 10
""")
def embed_custom(spark, sf):
    made = embedding.embed_texts(b.table(spark, sf, "documents"), _letter_shares, "vowels", id_col="doc_id")
    share = lambda i: F.round(F.col("embedding")[i].cast("double"), 6)
    return made.select("doc_id", "embedding_model", F.length("text_content").cast("long").alias("n_chars"),
                       share(0).alias("share_a"), share(4).alias("share_u"))


@query("embedding_refresh", """
SELECT count(*) FILTER (WHERE length(text) >= 10) AS processed, count(*) FILTER (WHERE length(text) < 10) AS skipped,
       count(*) AS total
FROM documents WHERE doc_id NOT IN (SELECT d.doc_id FROM documents d JOIN labels USING (doc_id) WHERE length(d.text) >= 10)
""")
def embedding_refresh(spark, sf):
    """A first run embeds the labelled documents, a second one the rest; its counts are given."""
    documents = b.table(spark, sf, "documents").select("doc_id", "text")
    labelled = integrity.keep_known(documents, b.table(spark, sf, "labels"), "doc_id")
    target = scratch_path(spark, "document-embeddings")

    def embed(df):
        return embedding.embed_by_hashing(df, id_col="doc_id", width=64)

    embedding.refresh_embeddings(labelled, target, embed, id_col="doc_id")
    return embedding.refresh_embeddings(documents, target, embed, id_col="doc_id")


@query("embedding_changes", """
SELECT doc_id, change, CASE WHEN change <> 'gone' THEN sha256(text) END AS stored_sha256 FROM (
  SELECT doc_id, text, CASE WHEN l.quality IS NULL THEN 'same' WHEN l.quality = 1 THEN 'new' ELSE 'changed' END AS change
  FROM documents LEFT JOIN labels l USING (doc_id) WHERE length(text) >= 10
  UNION ALL SELECT -1 - item_id, text, 'gone' FROM benchmark WHERE length(text) >= 10
)
""")
def embedding_changes(spark, sf):
    """Two states of a corpus: well labelled documents come in, badly labelled ones change, benchmark items go."""
    documents, quality = b.table(spark, sf, "documents").select("doc_id", "text"), b.table(spark, sf, "labels").select("doc_id", "quality")
    benchmark = b.table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    drafts = F.when(F.col("quality") == 0, F.concat(F.lit("draft: "), "text")).otherwise(F.col("text"))
    before = (
        documents.join(quality, "doc_id", "left").where("quality IS NULL OR quality = 0")
        .select("doc_id", drafts.alias("text")).unionByName(benchmark)
    )
    root = scratch_path(spark, "embedding-state")

    def embed(df):
        return embedding.embed_by_hashing(df, id_col="doc_id", width=64)

    embedding_state.refresh(before, root, embed, id_col="doc_id", buckets=16)
    changes = embedding_state.refresh(documents, root, embed, id_col="doc_id")
    stored = embedding_state.current(spark, root, embedding_state.state_schema(documents, embed))
    return changes.join(stored, "doc_id", "left").select("doc_id", "change", F.sha2("text_content", 256).alias("stored_sha256"))

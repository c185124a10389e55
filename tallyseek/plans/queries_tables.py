"""Source, sink, catalog and streaming queries.

Sinks write into a new folder next to the session's checkpoints and are read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseek.functions.lexicon import Lexicon
from tallyseek.functions.text import clean_for_ranking, strip_punctuation, whitespace_tokens
from tallyseek.operators import lexical as lx
from tallyseek.operators.chunking import chunk_texts
from tallyseek.operators.sizing import run_folder
from tallyseek.plans.facts import corpus, questions, table, table_stream
from tallyseek.plans.queries_retrieval import plain_corpus, plain_questions, rounded
from tallyseek.plans.queries_text import clean_sql
from tallyseek.plans.registry import query
from tallyseek.plans.sqltext import bm25_ctes, chunks_sql, plain, quoted, ranked, tfidf_ctes, tokens, words
from tallyseek.sources import readers as rd
from tallyseek.sources import tables as tb
from tallyseek.sources.segments import SegmentedIndex
from tallyseek.streaming.ingest import read_ingested, start_ingest
from tallyseek.streaming.questions import start_answers


# No word tables: tokens stay as they are written.
PLAIN = Lexicon({}, {}, {})


@query(
    "csv_round_trip",
    """SELECT doc_id::VARCHAR AS chunk_id, CAST(length(text) AS INTEGER) AS characters,
  md5(text) AS digest FROM documents""",
)
def csv_round_trip(spark, folder):
    """Chunk CSV written and read back: quotes, blanks and line ends survive."""
    path = run_folder(spark, "chunks-csv")
    tb.write_chunk_csv(corpus(spark, folder), path)
    schema = T.StructType(
        [T.StructField("chunk_id", T.StringType()), T.StructField("content", T.StringType())]
    )
    return rd.read_csv(spark, path, schema).select(
        "chunk_id", F.length("content").alias("characters"), F.md5("content").alias("digest")
    )


@query(
    "csv_in_ranges",
    """SELECT doc_id::VARCHAR AS chunk_id, CAST(length(text) AS INTEGER) AS characters,
  md5(text) AS digest FROM documents""",
)
def csv_in_ranges(spark, folder):
    """The same, read in ranges by many tasks though cells hold line ends."""
    path = run_folder(spark, "chunks-csv")
    tb.write_chunk_csv(corpus(spark, folder), path)
    chunks = rd.read_csv_ranges(spark, path)
    return chunks.select("chunk_id", F.length("content").alias("characters"), F.md5("content").alias("digest"))


@query(
    "json_corpus",
    """SELECT source || '-' || doc_id AS doc_id, CAST(length(text) AS INTEGER) AS characters,
  md5(text) AS digest FROM documents""",
)
def json_corpus(spark, folder):
    """Documents as `{id: text}` objects of some 200 each, one per line, written and read back."""
    path = run_folder(spark, "corpus-json")
    docs = corpus(spark, folder).select(
        "source", F.concat_ws("-", "source", "chunk_id").alias("key"), "content"
    )
    # An object is one JSON text, so it is cut at 200 documents, also for a large source.
    slices = docs.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(max(1, docs.count() // 200))))
    objects = slices.groupBy("slice").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "content")))).alias("value")
    )
    objects.repartition("slice").select("value").write.text(path)
    return rd.read_corpus_json(spark, path, whole_files=False).select(
        "doc_id", F.length("content").alias("characters"), F.md5("content").alias("digest")
    )


@query(
    "json_objects",
    "SELECT doc_id::VARCHAR AS doc_id, CAST(length(text) AS INTEGER) AS characters, md5(text) AS digest FROM documents",
)
def json_objects(spark, folder):
    """Documents as one object of some 1000 in each file, read in ranges."""
    path = run_folder(spark, "objects-json")
    docs = corpus(spark, folder).select(F.col("chunk_id").cast("string").alias("key"), "content")
    slices = docs.withColumn("file", F.pmod(F.xxhash64("key"), F.lit(max(1, docs.count() // 1000))))
    entries = F.map_from_entries(F.collect_list(F.struct("key", "content")))
    slices.groupBy("file").agg(F.to_json(entries).alias("value")).write.partitionBy("file").text(path)
    return rd.read_corpus_json(spark, f"{path}/*").select(
        "doc_id", F.length("content").alias("characters"), F.md5("content").alias("digest")
    )


@query(
    "text_files",
    "SELECT CAST(length(html) AS INTEGER) AS characters, md5(html) AS digest FROM pages",
)
def text_files(spark, folder):
    """Pages written to text files of some 200 pages each, read whole and taken apart."""
    path = run_folder(spark, "pages-text")
    pages = table(spark, folder, "pages").select(F.col("html").alias("value"))
    files = max(1, pages.count() // 200)
    pages.repartition(files).write.option("lineSep", "\u0001").text(path)
    parts = F.explode(F.split("content", "\u0001")).alias("html")
    found = rd.read_texts(spark, path).select(parts).filter(F.col("html") != "")
    return found.select(F.length("html").alias("characters"), F.md5("html").alias("digest"))


@query(
    "row_to_text",
    """SELECT p_partkey, 'p_partkey = ' || p_partkey || ', p_name = ' || p_name || ', p_brand = '
  || p_brand || ', p_type = ' || coalesce(nullif(p_type, 'ECONOMY'), 'nan') || ', p_size = '
  || p_size AS content FROM part""",
)
def row_to_text(spark, folder):
    """Parts as `name = value` text; one type plays the missing value."""
    parts = table(spark, folder, "part").withColumn("p_type", F.nullif("p_type", F.lit("ECONOMY")))
    columns = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    return rd.rows_to_text(parts, columns).select("p_partkey", "content")


LINE_ORDER = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
]


@query(
    "unique_ids",
    f"""SELECT CASE WHEN i > 0 THEN id || '_' || i ELSE id END AS id, l_partkey, l_suppkey,
  l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY {", ".join(LINE_ORDER)}) - 1 AS i
  FROM (SELECT *, l_orderkey || '-' || l_linenumber AS id FROM lineitem))""",
)
def unique_ids(spark, folder):
    """Line items share `order-line` ids; repeats get a suffix."""
    lines = table(spark, folder, "lineitem").withColumn(
        "id", F.concat_ws("-", "l_orderkey", "l_linenumber")
    )
    repaired = tb.repair_ids(lines, "id", LINE_ORDER)
    return repaired.select("id", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "hot_ids",
    f"""SELECT CASE WHEN i > 0 THEN id || '_' || i ELSE id END AS id, l_orderkey, l_linenumber,
  l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY l_orderkey, l_linenumber, {", ".join(LINE_ORDER)}) - 1 AS i
  FROM (SELECT *, l_returnflag AS id FROM lineitem))""",
)
def hot_ids(spark, folder):
    """Three ids hold all rows: numbering spreads over the range partitions."""
    lines = table(spark, folder, "lineitem").withColumn("id", F.col("l_returnflag"))
    repaired = tb.repair_ids(lines, "id", ["l_orderkey", "l_linenumber", *LINE_ORDER])
    return repaired.select("id", "l_orderkey", "l_linenumber", "l_extendedprice")


REPAIRED_CTE = """r AS (SELECT CASE WHEN n_nationkey = 4 THEN NULL WHEN n_nationkey = 5 THEN '1_1'
    ELSE (n_regionkey + 1)::VARCHAR END AS id, n_name FROM nation),
t AS (SELECT id, n_name FROM r UNION ALL SELECT id, n_name FROM r),
a AS (SELECT coalesce(id, 'null') AS id, n_name,
  row_number() OVER (PARTITION BY coalesce(id, 'null') ORDER BY n_name) - 1 AS i FROM t),
b AS (SELECT CASE WHEN i > 0 THEN id || '_' || i ELSE id END AS id, n_name FROM a),
c AS (SELECT id, n_name, row_number() OVER (PARTITION BY id ORDER BY n_name) - 1 AS i FROM b),
d AS (SELECT CASE WHEN i > 0 THEN id || '_' || i ELSE id END AS id, n_name FROM c),
e AS (SELECT id, n_name, row_number() OVER (PARTITION BY id ORDER BY n_name) - 1 AS i FROM d)"""


@query(
    "repaired_duplicates",
    f"""WITH {REPAIRED_CTE} SELECT CASE WHEN i > 0 THEN id || '_' || i ELSE id END AS id, n_name
FROM e""",
)
def repaired_duplicates(spark, folder):
    """Nations twice over: equal rows, a missing id, and an id that a repair would also give."""
    key = F.col("n_nationkey")
    rows = table(spark, folder, "nation").select(
        F.when(key == 4, F.lit(None).cast("string")).when(key == 5, F.lit("1_1"))
        .otherwise((F.col("n_regionkey") + 1).cast("string")).alias("id"),
        "n_name",
    )
    return tb.repair_ids(rows.unionByName(rows), "id", ["n_name"])


@query(
    "union_sources",
    """SELECT id, source, CAST(length(text) AS INTEGER) AS characters FROM (
  SELECT doc_id::VARCHAR AS id, source, text FROM documents
  UNION ALL SELECT page_id::VARCHAR, 'pages', html FROM pages
  UNION ALL SELECT conv_id || '-' || turn, 'conversations', text FROM conversations)""",
)
def union_sources(spark, folder):
    parts = [
        corpus(spark, folder).select(F.col("chunk_id").cast("string").alias("id"), "source", "content"),
        table(spark, folder, "pages").select(
            F.col("page_id").cast("string").alias("id"), F.lit("pages").alias("source"),
            F.col("html").alias("content"),
        ),
        table(spark, folder, "conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("id"),
            F.lit("conversations").alias("source"), F.col("text").alias("content"),
        ),
    ]
    combined = tb.combine_sources(parts)
    return combined.select("id", "source", F.length("content").alias("characters"))


@query(
    "list_sources",
    "SELECT source, count(*) AS chunks FROM documents GROUP BY source",
)
def list_sources(spark, folder):
    return tb.list_sources(corpus(spark, folder))


@query(
    "delete_source",
    "SELECT source, count(*) AS chunks FROM documents WHERE source <> 'src3' GROUP BY source",
)
def delete_source(spark, folder):
    """Chunks stored, one source removed from the stored table, the rest listed."""
    path = run_folder(spark, "chunks")
    tb.write_chunks(corpus(spark, folder), path)
    tb.delete_stored_source(spark, path, "src3")
    return tb.list_sources(tb.read_stored_chunks(spark, path))


@query(
    "reindex_after_delete",
    f"""WITH d AS (SELECT doc_id, {tokens(plain("text"))} AS tk FROM documents
  WHERE source <> 'src3' AND {plain("text")} <> '')
SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(tk) AS term FROM d)
GROUP BY term""",
)
def reindex_after_delete(spark, folder):
    """The stored term table after a source is gone."""
    left = tb.delete_source(plain_corpus(spark, folder), "src3")
    return tb.reindex(left, run_folder(spark, "index")).terms


@query(
    "reindex_all",
    f"""WITH {tfidf_ctes("CASE WHEN source <> 'src3' THEN text ELSE '' END")},
{bm25_ctes("CASE WHEN source <> 'src3' THEN text ELSE '' END")}
SELECT 'term' AS kind, term AS key, df::DOUBLE AS value FROM bm_df
UNION ALL SELECT 'norm', chunk_id::VARCHAR, round(norm, 6) FROM tf_norm
UNION ALL SELECT 'vector', doc_id::VARCHAR, len({words("text")})::DOUBLE FROM documents
  WHERE source <> 'src3' AND len({words("text")}) > 0""",
)
def reindex_all(spark, folder):
    """Terms, TF-IDF norms and word vectors rebuilt after a delete, read back from their tables."""
    path = run_folder(spark, "indexes")
    left = tb.delete_source(corpus(spark, folder), "src3")
    cleaned = tb.delete_source(plain_corpus(spark, folder), "src3")
    tb.reindex_all(cleaned, left, path)
    terms = tb.read_index(spark, f"{path}/bm25").terms.select(
        F.lit("term").alias("kind"), F.col("term").alias("key"), F.col("df").cast("double").alias("value")
    )
    norms = tb.read_index(spark, f"{path}/tfidf").chunks.filter("norm IS NOT NULL").select(
        F.lit("norm").alias("kind"), F.col("chunk_id").cast("string").alias("key"), F.round("norm", 6).alias("value")
    )
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    vectors = tb.read_embeddings(spark, f"{path}/vectors").select(
        F.lit("vector").alias("kind"), F.col("chunk_id").cast("string").alias("key"), total.alias("value")
    )
    return terms.unionByName(norms).unionByName(vectors)


@query(
    "segmented_index",
    f"""WITH d AS (SELECT doc_id, {tokens(plain("text"))} AS tk FROM documents
  WHERE source <> 'src3' AND {plain("text")} <> '')
SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(tk) AS term FROM d)
GROUP BY term""",
)
def segmented_index(spark, folder):
    """Sources ingested in two segments, one of them replaced by a third, one deleted, all merged: the term table read in full."""
    docs = plain_corpus(spark, folder)
    index = SegmentedIndex(spark, run_folder(spark, "segments"))
    index.ingest(docs.filter("source <> 'src1'"))
    index.ingest(docs.filter("source = 'src1'").withColumn("content", F.concat_ws(" ", F.lit("earlier"), "content")))
    index.ingest(docs.filter("source = 'src1'"))
    index.delete("src3")
    before = index.read()
    index.merge()
    # The reader of the version before the merge and the one after it see the same corpus.
    counts = before.terms.withColumnRenamed("df", "old").join(index.read().terms, "term", "full")
    return counts.select("term", F.when(F.col("old").eqNullSafe(F.col("df")), F.col("df")).alias("df"))


@query(
    "stored_index_top3",
    f"""WITH {bm25_ctes()} SELECT query_id, chunk_id, round(score, 6) AS score,
  CAST(rank AS INTEGER) AS rank FROM ({ranked("bm_all", 3)})""",
)
def stored_index_top3(spark, folder):
    """Index written to Parquet, loaded again, and asked."""
    path = run_folder(spark, "index")
    tb.reindex(plain_corpus(spark, folder), path)
    index = tb.read_index(spark, path)
    return rounded(lx.bm25_top_k(None, plain_questions(spark, folder), 3, index=index))


@query(
    "embedding_store",
    """SELECT vec_id::VARCHAR AS chunk_id, CAST(len(embedding) AS INTEGER) AS dimensions,
  round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""",
)
def embedding_store(spark, folder):
    """Embeddings through the tab-separated form and back."""
    path = run_folder(spark, "embeddings-tsv")
    vectors = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    tb.write_embeddings_tsv(vectors, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return tb.read_embeddings_tsv(spark, path).select(
        "chunk_id", F.size("embedding").alias("dimensions"), F.round(total, 6).alias("total")
    )


@query(
    "result_tables",
    f"""WITH {bm25_ctes()} SELECT item_id AS query_id, text AS question,
  string_agg(chunk_id::VARCHAR, ' ' ORDER BY rank) AS doc_id
FROM ({ranked("bm_all", 3)}) JOIN benchmark ON item_id = query_id GROUP BY ALL""",
)
def result_tables(spark, folder):
    """One row per question with its best ids joined by blanks."""
    ranking = lx.bm25_top_k(plain_corpus(spark, folder), plain_questions(spark, folder), 3)
    return tb.result_table(ranking, questions(spark, folder))


@query(
    "chunk_counts",
    f"""SELECT source, count(*) AS chunks, max(length(content))::INT AS longest
FROM ({chunks_sql("SELECT page_id::VARCHAR AS source, html AS content FROM pages")}) GROUP BY source""",
)
def chunk_counts(spark, folder):
    """Pages with their markup, chunked; chunks and longest chunk per page."""
    texts = table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("source"), F.col("html").alias("content")
    )
    return chunk_texts(texts).groupBy("source").agg(
        F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest")
    )


LEMMAS = {"the": "the-lemma", "and": "and-lemma", "der": "der-lemma", "les": "les-lemma"}


@query(
    "lemmatized",
    f"""SELECT doc_id AS chunk_id, array_to_string(list_transform({tokens(plain("text"))},
  lambda t: coalesce(MAP {{{", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in LEMMAS.items())}}}[t],
  t)), ' ') AS clean FROM documents""",
)
def lemmatized(spark, folder):
    """Tokens replaced from a lemma table that is derived from the corpus' own words."""
    from tallyseek.functions.text import lemmatize

    docs = corpus(spark, folder).select(
        "chunk_id", strip_punctuation(F.col("content")).alias("clean")
    )
    words = docs.select(F.explode(whitespace_tokens(F.col("clean"))).alias("token")).distinct()
    lemmas = words.filter(F.col("token").isin(list(LEMMAS))).withColumn(
        "lemma", F.concat_ws("-", "token", F.lit("lemma"))
    )
    return lemmatize(docs, lemmas)


@query(
    "cleaned_for_ranking",
    f"""WITH l AS (SELECT DISTINCT token FROM (SELECT unnest(string_split(lower(text), ' ')) AS token
  FROM conversations) WHERE length(token) > 8),
c AS (SELECT conv_id || '-' || turn AS chunk_id, {tokens(clean_sql("text"))} AS tk FROM conversations),
w AS (SELECT chunk_id, unnest(tk) AS t, generate_subscripts(tk, 1) AS i FROM c),
j AS (SELECT chunk_id, string_agg(coalesce(substr(token, 1, 8), t), ' ' ORDER BY i) AS clean
  FROM w LEFT JOIN l ON token = t GROUP BY chunk_id)
SELECT chunk_id, coalesce(clean, '') AS clean FROM c LEFT JOIN j USING (chunk_id)""",
)
def cleaned_for_ranking(spark, folder):
    """The cleaning chain plus lemmas over every conversation turn."""
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("text").alias("content")
    )
    lemmas = turns.select(F.explode(F.split(F.lower("content"), " ")).alias("token")).distinct()
    lemmas = lemmas.filter(F.length("token") > 8).withColumn("lemma", F.substring("token", 1, 8))
    return clean_for_ranking(turns, lemmas).select("chunk_id", "clean")


@query(
    "stream_ingest",
    f"""SELECT count(*) AS documents FROM documents WHERE trim({plain("text")}) <> ''""",
)
def stream_ingest(spark, folder):
    """Documents arriving as a file stream become chunks; how many documents got chunks."""
    path = run_folder(spark, "ingest")
    texts = table_stream(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("source"), F.col("text").alias("content")
    )
    start_ingest(texts, path).awaitTermination()
    chunks, _ = read_ingested(spark, path)
    usable = chunks.filter(F.trim("clean") != "")
    return usable.agg(F.count_distinct("source").alias("documents"))


@query(
    "stream_reingest",
    f"""WITH d AS (SELECT doc_id, {tokens(plain("text"))} AS tk FROM documents WHERE len({tokens(plain("text"))}) > 0)
SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(tk) AS term FROM d) GROUP BY term""",
)
def stream_reingest(spark, folder):
    """Every document arrives twice, first with another text; the term table holds the second only."""
    path, inbox = run_folder(spark, "reingest"), run_folder(spark, "inbox")
    docs = table(spark, folder, "documents")
    for text in (F.concat(F.lit("earlier "), F.reverse("text")), F.col("text")):
        # Bare words, so that the splitter and the cleaning chain leave them as they are.
        bare = F.array_join(whitespace_tokens(strip_punctuation(text)), " ")
        arrived = docs.select(F.col("doc_id").cast("string").alias("source"), bare.alias("content"))
        arrived.write.mode("append").option("compression", "zstd").parquet(inbox)
        stream = spark.readStream.schema(arrived.schema).parquet(inbox)
        start_ingest(stream, path, PLAIN).awaitTermination()
    chunks, index = read_ingested(spark, path)
    owner = index.postings.join(chunks.select("chunk_id", "source"), "chunk_id")
    return owner.groupBy("term").agg(F.count_distinct("source").alias("df"))


@query(
    "stream_answers",
    f"""WITH {bm25_ctes()} SELECT query_id, chunk_id, round(score, 6) AS score,
  CAST(rank AS INTEGER) AS rank FROM ({ranked("bm_all", 3)})""",
)
def stream_answers(spark, folder):
    """Questions arriving as a file stream, answered from a stored index."""
    path = run_folder(spark, "answers")
    tb.reindex(plain_corpus(spark, folder), f"{path}/index")
    asked = table_stream(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        strip_punctuation(F.col("text")).alias("question"),
    )

    def answer(batch):
        return lx.bm25_top_k(None, batch, 3, index=tb.read_index(spark, f"{path}/index"))

    start_answers(asked, answer, path).awaitTermination()
    return rounded(spark.read.parquet(f"{path}/answers"))


@query(
    "ranking_files",
    f"""WITH {bm25_ctes()}, {tfidf_ctes()},
a AS ({ranked("bm_all", 3)}), b AS ({ranked("tf_all", 3, "cosine")}),
u AS (SELECT 'bm25plus' AS model, query_id, chunk_id, rank FROM a
  UNION ALL SELECT 'tf_idf', query_id, chunk_id, rank FROM b)
SELECT model, md5(text) AS question, string_agg(chunk_id::VARCHAR, ' ' ORDER BY rank) AS doc_id
FROM u JOIN benchmark ON item_id = query_id GROUP BY model, query_id, text""",
)
def ranking_files(spark, folder):
    """Two rankers' result files, written and read back."""
    path = run_folder(spark, "rankings")
    asked = questions(spark, folder)
    tb.write_ranking(
        {
            "bm25plus": lx.bm25_top_k(plain_corpus(spark, folder), plain_questions(spark, folder), 3),
            "tf_idf": lx.tfidf_top_k(corpus(spark, folder), asked, 3),
        },
        asked,
        path,
    )
    parts = [
        rd.read_csv(spark, f"{path}/{model}").select(
            F.lit(model).alias("model"), F.md5("question").alias("question"), "doc_id"
        )
        for model in ("bm25plus", "tf_idf")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "files_by_type",
    """SELECT 'txt' AS kind, md5(string_agg(n_name, chr(10) ORDER BY n_nationkey)) AS digest, true AS clean
FROM nation GROUP BY n_regionkey
UNION ALL SELECT 'csv', md5('r_regionkey = ' || r_regionkey || ', r_name = ' || r_name), false FROM region
UNION ALL SELECT 'json', md5('{' || chr(10) || '  "' || r_name || '": ' || r_regionkey || chr(10) || '}'), true FROM region""",
)
def files_by_type(spark, folder):
    """Nations as text files, regions as CSV rows and JSON files, read by their extensions."""
    path = run_folder(spark, "files")
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    names = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: r["n_name"]), "\n"
    )
    lists = nations.groupBy("n_regionkey").agg(names.alias("value")).select("value", F.col("n_regionkey").alias("file"))
    lists.write.partitionBy("file").option("lineSep", "\u0001").text(f"{path}/txt")
    objects = regions.select(
        F.concat(F.lit('{"'), "r_name", F.lit('": '), F.col("r_regionkey").cast("string"), F.lit("}")).alias("value"),
        F.col("r_regionkey").alias("file"),
    )
    objects.write.partitionBy("file").text(f"{path}/json")
    regions.select("r_regionkey", "r_name").coalesce(1).write.option("header", True).csv(f"{path}/csv")
    # Spark names all text files .txt, so the JSON files are read by their own reader.
    texts = rd.read_texts(spark, f"{path}/txt/*").select(
        F.lit("txt").alias("kind"), F.rtrim(F.translate("content", "\u0001", "")).alias("content"), F.lit(True).alias("clean")
    )
    rows = rd.read_chunks(spark, [f"{path}/csv/*.csv"]).select(F.lit("csv").alias("kind"), "content", "clean")
    json_texts = rd.read_json_texts(spark, f"{path}/json/*").select(
        F.lit("json").alias("kind"), "content", F.lit(True).alias("clean")
    )
    every = texts.unionByName(rows).unionByName(json_texts)
    return every.select("kind", F.md5("content").alias("digest"), "clean")


@query(
    "built_once",
    "SELECT count(*) * 2 AS chunks, count(DISTINCT source) AS sources, 1::BIGINT AS builds FROM documents",
)
def built_once(spark, folder):
    """A table built at the first request and read at the second."""
    path, builds = run_folder(spark, "built"), []

    def build():
        builds.append(1)
        return corpus(spark, folder)

    first, second = (tb.read_or_build(spark, path, build) for _ in range(2))
    return first.unionByName(second).agg(
        F.count("*").alias("chunks"), F.count_distinct("source").alias("sources")
    ).withColumn("builds", F.lit(len(builds)).cast("long"))

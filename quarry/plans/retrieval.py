"""Registered queries over documents, benchmark and embeddings: ranking, fusion, metrics, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import citations as ci
from ..operators import evaluation as ev
from ..operators import inverted_index as ii
from ..operators import retrieval as re_
from ..operators import vector_index as vi
from ..sources import files
from .base import LINES_SQL, ocr_pages, questions, table


def _bm25(spark: SparkSession, sf_dir: str, **options: float) -> DataFrame:
    return re_.bm25(table(spark, sf_dir, "documents"), questions(spark, sf_dir), **options)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _terms_sql(name: str, source: str, key: str) -> str:
    return f"""{name}_lowered AS (SELECT {key}, translate(lower(text), '０１', '01') AS t FROM {source}),
{name}_runs AS (SELECT {key}, unnest(regexp_extract_all(t, '[一-鿿]+')) AS run FROM {name}_lowered),
{name} AS (
  SELECT {key}, unnest(regexp_extract_all(t, '(?i)[a-z]+\\d*(?:\\.\\d+)?|\\d+(?:\\.\\d+)?')) AS term FROM {name}_lowered
  UNION ALL SELECT {key}, unnest(string_split(run, '')) FROM {name}_runs
  UNION ALL SELECT {key}, unnest(list_transform(generate_series(1, length(run) - 1), lambda i: substring(run, i, 2))) FROM {name}_runs)"""


def _bm25_sql(b: str = "0.75", k1: str = "1.5") -> str:
    return f"""
{_terms_sql("doc_terms", "documents", "doc_id")},
{_terms_sql("query_tokens", "benchmark", "item_id")},
tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
sizes AS (SELECT d.doc_id, coalesce(n, 0) AS length FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY ALL) USING (doc_id)),
stats AS (SELECT count(*) AS n, avg(length) AS mean FROM sizes),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
qtf AS (SELECT item_id, term, count(*) AS qtf FROM query_tokens GROUP BY ALL),
matched AS (
  SELECT item_id AS query_id, tf.doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
         * (tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * length / mean)))), 8) AS score
  FROM qtf JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (doc_id) CROSS JOIN stats GROUP BY ALL),
scored AS (
  SELECT i.item_id AS query_id, d.doc_id, coalesce(m.score, 0) AS score FROM documents d CROSS JOIN benchmark i LEFT JOIN matched m ON m.query_id = i.item_id AND m.doc_id = d.doc_id),
bm25 AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS rank
  FROM scored QUALIFY rank <= 10)"""


BM25_SQL = f"WITH {_bm25_sql()} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm25"


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, distinct tokens and the most frequent token of each document's page, ideographs included."""
    pages = ocr_pages(spark, sf_dir).select(F.substring("document_id", 2, 20).cast("long").alias("doc_id"), F.array_join(F.col("results")[0]["rec_texts"], "\n").alias("text"))
    counts = re_.term_counts(pages, "doc_id", "text")
    top = F.min_by("term", F.struct((-F.col("tf")).alias("n"), "term"))
    return counts.groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms"), top.alias("top_term"), F.max("tf").alias("top_tf"))


TERM_SQL = f"""WITH {LINES_SQL}, whole AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_index) AS text FROM raw_lines GROUP BY doc_id),
{_terms_sql("doc_terms", "whole", "doc_id")},
tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL)
SELECT doc_id, sum(tf)::BIGINT AS n_tokens, count(*) AS n_terms, arg_min(term, (-tf, term)) AS top_term, max(tf) AS top_tf FROM tf GROUP BY doc_id"""


def indexed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk from a stored index: documents are added in two segments, by language, and ranked; the index is
    removed once the ranking, of k rows a query, is written."""
    index = ii.InvertedIndex(spark, files.scratch_folder(spark))
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    for some in (docs.where("lang = 'en'"), docs.where("not (lang <=> 'en')")):
        ii.add_documents(index, some, order=("source", "lang"))
    ranked = files.durable(ii.indexed_bm25(index, asked))
    files.remove_folder(spark, index.path)
    return ranked.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return re_.dense_top_k(vectors, asked)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "score")


DENSE_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
scored AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.e, d.e) / (q.size * d.size), 6) AS score FROM u q CROSS JOIN u d WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id::VARCHAR) AS rank, score FROM scored QUALIFY rank <= 10
"""


def indexed_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dense_topk from a stored index, which is removed once the ranking, of k rows a query, is written."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = vi.VectorIndex(spark, files.scratch_folder(spark))
    vi.build_vector_index(index, vectors)
    ranked = files.durable(vi.indexed_dense_top_k(index, asked))
    files.remove_folder(spark, index.path)
    return ranked.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "score")


def char_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = re_.character_overlap_top_k(table(spark, sf_dir, "documents"), questions(spark, sf_dir))
    return found.select("query_id", "doc_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


OVERLAP_SQL = """
WITH d AS (SELECT doc_id, unnest(list_distinct(string_split(text, ''))) AS c FROM documents),
q AS (SELECT item_id, unnest(list_distinct(string_split(text, ''))) AS c FROM benchmark),
s AS (SELECT item_id AS query_id, doc_id, count(*) AS score FROM q JOIN d USING (c) GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10
"""


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = re_.character_overlap_top_k(table(spark, sf_dir, "documents"), questions(spark, sf_dir))
    fused = re_.reciprocal_rank_fusion(_bm25(spark, sf_dir), other, "query_id", "doc_id")
    return fused.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


RRF_SQL = f"""
WITH {_bm25_sql()}, overlap AS ({OVERLAP_SQL}),
both_ AS (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT query_id, doc_id, rank FROM overlap),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM both_ GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS rank FROM f QUALIFY rank <= 10
"""


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = re_.character_overlap_top_k(table(spark, sf_dir, "documents"), questions(spark, sf_dir))
    fused = re_.weighted_fusion(_bm25(spark, sf_dir), other, "query_id", "doc_id", 0.5)
    return fused.select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


WEIGHTED_SQL = f"""
WITH {_bm25_sql()}, overlap AS ({OVERLAP_SQL}),
both_ AS (SELECT query_id, doc_id, score::DOUBLE AS score, 1 AS m FROM bm25 UNION ALL SELECT query_id, doc_id, score::DOUBLE, 2 FROM overlap),
scaled AS (SELECT query_id, doc_id, 0.5::DOUBLE * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS part
           FROM both_ WINDOW w AS (PARTITION BY query_id, m)),
f AS (SELECT query_id, doc_id, round(sum(part), 8) AS score FROM scaled GROUP BY ALL)
SELECT query_id, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS rank FROM f QUALIFY rank <= 10
"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments as evidence labels: of the documents with a question's id and every tenth further one, those labelled
    as of good quality, twice as relevant if their id is even; questions with ids divisible by five have none."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    meant = questions(spark, sf_dir).where("query_id % 5 <> 0").select("query_id", F.explode(F.expr("sequence(query_id, query_id + 990, 10)")).alias("doc_id"))
    grade = F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)
    item = F.struct(F.col("doc_id").cast("string").alias("evidence_id"), grade.alias("relevance"))
    held = meant.join(good, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("relevant_evidence"))
    every = questions(spark, sf_dir).select("query_id").join(held, "query_id", "left")
    return every.select(F.col("query_id").cast("string").alias("question_id"), F.coalesce("relevant_evidence", F.array().cast("array<struct<evidence_id:string,relevance:int>>")).alias("relevant_evidence"))


def _runs(spark: SparkSession, sf_dir: str, ranked: DataFrame | None = None) -> DataFrame:
    """Runs of every question, BM25's if none are given, with its judgments."""
    runs = re_.as_runs(_bm25(spark, sf_dir) if ranked is None else ranked, "query_id", "doc_id")
    return re_.graded_judgments(_labels(spark, sf_dir)).join(runs, "question_id", "left")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M5, A8."""
    row = ev.evaluate_retrieval(_runs(spark, sf_dir))
    return row.select(*[F.round(F.col(f"`{c}`"), 6).alias(c.replace("@", "_at_")) if c not in ("answerable_queries", "unanswerable_queries") else F.col(c) for c in row.columns])


RELEVANT = """rel AS (
  SELECT query_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS grade
  FROM (SELECT item_id AS query_id, unnest(generate_series(item_id, item_id + 990, 10)) AS doc_id FROM benchmark WHERE item_id % 5 <> 0) JOIN good USING (doc_id))"""


def _metrics_sql(inner: str) -> str:
    return f"""
WITH {_bm25_sql()}, good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
{RELEVANT},
j AS (SELECT b.query_id, b.rank, r.grade FROM bm25 b LEFT JOIN rel r USING (query_id, doc_id)),
sizes_of AS (SELECT i.item_id AS query_id, count(r.doc_id) AS n FROM benchmark i LEFT JOIN rel r ON r.query_id = i.item_id GROUP BY 1),
ideal AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS pos FROM rel),
q AS (SELECT query_id, any_value(n) AS n, coalesce(1.0::DOUBLE / min(rank) FILTER (grade IS NOT NULL), 0) AS rr, coalesce(min(rank) FILTER (grade IS NOT NULL), 0) AS first,
      {", ".join(f"count(grade) FILTER (rank <= {k}) AS f{k}, coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= {k}), 0) AS g{k}" for k in (1, 3, 5, 10))}
      FROM sizes_of LEFT JOIN j USING (query_id) GROUP BY query_id),
i AS (SELECT query_id, {", ".join(f"sum((2 ** grade - 1) / log2(pos + 1)) FILTER (pos <= {k}) AS i{k}" for k in (1, 3, 5, 10))} FROM ideal GROUP BY query_id)
{inner}"""


METRICS_SQL = _metrics_sql(
    "SELECT count(*) FILTER (n > 0) AS answerable_queries, count(*) FILTER (n = 0) AS unanswerable_queries, round(coalesce(avg(rr) FILTER (n > 0), 0), 6) AS mrr, "
    + ", ".join(
        f"round(coalesce(avg(f{k}::DOUBLE / n) FILTER (n > 0), 0), 6) AS recall_at_{k}, round(coalesce(avg((f{k} > 0)::INT) FILTER (n > 0), 0), 6) AS hit_at_{k}, round(coalesce(avg(g{k} / i{k}) FILTER (n > 0), 0), 6) AS ndcg_at_{k}"
        for k in (1, 3, 5, 10)
    )
    + " FROM q LEFT JOIN i USING (query_id)"
)


def simple_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, A9."""
    row = ev.evaluate_simple(_runs(spark, sf_dir))
    return row.select("queries", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_5", "hit_at_10", "mrr")], "without_hit")


SIMPLE_SQL = _metrics_sql(
    "SELECT count(*) AS queries, "
    + ", ".join(f"round(avg((f{k} > 0)::INT), 6) AS hit_at_{k}" for k in (1, 5, 10))
    + ", round(avg(rr), 6) AS mrr, count(*) FILTER (first = 0) AS without_hit FROM q"
)


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 against ranking without length normalisation, by two groups of questions."""

    def results(ranked: DataFrame) -> DataFrame:
        return ev.evaluate_simple(_runs(spark, sf_dir, ranked).withColumn("profile", F.concat(F.lit("p"), F.pmod(F.col("question_id").cast("int"), F.lit(2)))), "profile")

    ranked = re_.bm25_each(table(spark, sf_dir, "documents"), questions(spark, sf_dir), {"default": (1.5, 0.75), "flat": (1.5, 0.0)})
    return ev.compare_methods({name: results(rows) for name, rows in ranked.items()})


def compare_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better group of questions for each way of ranking."""
    return ev.best_profile(_profiles(spark, sf_dir)).select("method", "profile", F.round("mrr", 6).alias("mrr"))


def _compare_part(method: str, b: str) -> str:
    return f"""(WITH {_bm25_sql(b)}, good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), {RELEVANT},
  r AS (SELECT query_id, min(rank) FILTER (r.doc_id IS NOT NULL) AS first FROM bm25 b LEFT JOIN rel r USING (query_id, doc_id) GROUP BY query_id)
  SELECT '{method}' AS method, 'p' || (query_id % 2) AS profile, coalesce(avg(coalesce(1.0::DOUBLE / first, 0)), 0) AS m, {", ".join(f"avg(coalesce(first <= {k}, false)::INT) AS h{k}" for k in (1, 5, 10))} FROM r GROUP BY ALL)"""


PROFILES = f"""c AS ({_compare_part("default", "0.75")} UNION ALL {_compare_part("flat", "0.0")})"""

COMPARE_SQL = f"""
WITH {PROFILES}
SELECT method, arg_min(profile, (-m, profile)) AS profile, round(max(m), 6) AS mrr FROM c GROUP BY method
"""


def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: the comparison as a Markdown table, a row per line of it."""
    lines = ev.comparison_table(_profiles(spark, sf_dir)).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, markdown string")


TABLE_SQL = f"""
WITH {PROFILES},
body AS (SELECT row_number() OVER (ORDER BY profile, method) + 1 AS line, format('| {{}} | {{}} | {{:.3f}} | {{:.3f}} | {{:.3f}} | {{:.3f}} |', profile, method, h1, h5, h10, m) AS markdown FROM c)
SELECT line::INT AS line, markdown FROM body UNION ALL VALUES (0, '| profile | method | Hit@1 | Hit@5 | Hit@10 | MRR |'), (1, '|---|---|---|---|---|---|') UNION ALL SELECT (max(line) + 1)::INT, '' FROM body
"""


def user_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of each query's second and first result."""
    docs = table(spark, sf_dir, "documents")
    pages = F.array(F.pmod("doc_id", F.lit(50)).cast("int") + 1, F.pmod("doc_id", F.lit(50)).cast("int") + F.pmod("doc_id", F.lit(3)).cast("int") + 1)
    source = F.struct(
        F.col("source").alias("document_id"),
        F.concat(F.lit("title "), "lang").alias("document_title"),
        pages.alias("pdf_pages"),
        pages.alias("printed_pages"),
        F.when(F.col("lang") == "en", F.array(F.concat(F.lit("section "), "source"))).otherwise(F.array().cast("array<string>")).alias("title_paths"),
        F.array(F.col("doc_id").cast("string")).alias("source_block_ids"),
        F.col("source").alias("quote"),
    )
    ranked = _bm25(spark, sf_dir).join(docs.select("doc_id", source.alias("citation")), "doc_id")
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("id"), "score", "citation"))).alias("results"))
    asked = rows.select("query_id", F.concat(F.lit(" answer "), "query_id").alias("answer"), "results", F.reverse(F.transform(F.slice("results", 1, 2), lambda r: r["id"])).alias("cited_chunk_ids"))
    cited = ci.attach_citations(asked).select("query_id", "answer", F.explode("citations").alias("c"))
    return cited.select("query_id", "answer", F.col("c.citation_number").cast("long").alias("citation_number"), "c.chunk_id", "c.section", "c.display", F.round("c.retrieval_score", 6).alias("retrieval_score"))


CITATIONS_SQL = f"""
WITH {_bm25_sql()}, top AS (SELECT query_id, doc_id, rank, score, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS n FROM bm25 WHERE rank <= 2)
SELECT query_id, 'answer ' || query_id AS answer, n AS citation_number, doc_id::VARCHAR AS chunk_id, CASE WHEN lang = 'en' THEN 'section ' || source END AS section,
       '[' || n || ']《title ' || lang || '》第' || (doc_id % 50 + 1) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '—' || (doc_id % 50 + doc_id % 3 + 1) END || '页'
       || CASE WHEN lang = 'en' THEN '，section ' || source ELSE '' END AS display, round(score, 6) AS retrieval_score
FROM top JOIN documents USING (doc_id)
"""


def lexicon_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken forms in benchmark passages replaced by standard ones; the lexicon comes from the region table's names."""
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("std"), "r_regionkey").alias("standard"), F.element_at(F.array(F.lit("the;thing"), F.lit("er/ing"), F.lit("qu"), F.lit("an"), F.lit("on")), F.col("r_regionkey") + 1).alias("variants"))
    lexicon = re_.lexicon_entries(regions, "standard", "variants")
    return re_.normalize_spoken(questions(spark, sf_dir), lexicon).select("query_id", "normalized_query")


LEXICON_SQL = """
SELECT item_id AS query_id, replace(replace(replace(replace(replace(replace(replace(text, 'thing', 'std0'), 'ing', 'std1'), 'the', 'std0'), 'an', 'std3'), 'er', 'std1'), 'on', 'std4'), 'qu', 'std2') AS normalized_query
FROM benchmark
"""


def filtered_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata filter ahead of BM25, and F15's fallback for texts."""
    docs = re_.metadata_filter(table(spark, sf_dir, "documents"), lang=["fr", "de"])
    docs = re_.select_text(docs, "text", F.col("source"))
    return re_.bm25(docs, questions(spark, sf_dir)).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


FILTERED_SQL = "WITH all_docs AS (SELECT * FROM documents), " + _bm25_sql().replace("FROM documents", "FROM (SELECT * FROM documents WHERE lang IN ('fr', 'de'))") + " SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm25"


def code_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: the distinct codes that each document mentions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.code_mentions(F.col("text")).alias("codes"))
    return docs.select("doc_id", F.size("codes").cast("long").alias("code_count"), F.array_join("codes", "|").alias("codes"))


CODES_SQL = r"""
WITH m AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(' ' || text, '([A-Za-z]+)', ' \1', 'g'), '(?i)[^A-Za-z]([GMTFSXYZIJKRPQ]\s*[+-]?\d+(?:\.\d+)?)', 1), lambda x: replace(x, ' ', '')) AS found FROM documents)
SELECT doc_id, len(list_distinct(found)) AS code_count, coalesce(array_to_string(list_sort(list_distinct(found)), '|'), '') AS codes FROM m
"""


def normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors, with their length and their cosine to the sum of the axes."""
    unit = re_.normalized_vectors(table(spark, sf_dir, "embeddings"))
    e, ones = F.col("embedding"), F.transform("embedding", lambda _: F.lit(1.0))
    return unit.select("vec_id", F.round(vx.dot(e, e), 6).alias("squared"), F.round(vx.dot(e, ones), 6).alias("total"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


VECTORS_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings)
SELECT vec_id, round(list_dot_product(e, e) / (size * size), 6) AS squared, round(list_sum(e) / size, 6) AS total, round(e[1] / size, 6) AS first FROM v
"""


def selected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the text field that a ranker is given, with a fallback where it is empty."""
    docs = table(spark, sf_dir, "documents").withColumn("title", F.when(F.col("lang") == "en", F.lit("")).when(F.col("lang") == "fr", F.lit(None)).otherwise(F.concat("source", F.lit(": "), "text")))
    return re_.select_text(docs, "title", F.col("text")).select("doc_id", F.md5("text").alias("text_md5"))


SELECTED_SQL = """
WITH titled AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN '' WHEN 'fr' THEN NULL ELSE source || ': ' || text END AS title FROM documents)
SELECT doc_id, md5(CASE WHEN title <> '' THEN title ELSE text END) AS text_md5 FROM titled
"""

QUERIES = {
    "bm25_topk": (bm25_topk, BM25_SQL),
    "indexed_bm25": (indexed_bm25, BM25_SQL),
    "term_statistics": (term_statistics, TERM_SQL),
    "dense_topk": (dense_topk, DENSE_SQL),
    "indexed_dense": (indexed_dense, DENSE_SQL),
    "char_overlap_topk": (char_overlap_topk, OVERLAP_SQL),
    "rrf_fusion": (rrf_fusion, RRF_SQL),
    "weighted_fusion": (weighted_fusion, WEIGHTED_SQL),
    "retrieval_metrics": (retrieval_metrics, METRICS_SQL),
    "simple_metrics": (simple_metrics, SIMPLE_SQL),
    "compare_profiles": (compare_profiles, COMPARE_SQL),
    "comparison_table": (comparison_table, TABLE_SQL),
    "user_citations": (user_citations, CITATIONS_SQL),
    "lexicon_normalize": (lexicon_normalize, LEXICON_SQL),
    "filtered_bm25": (filtered_bm25, FILTERED_SQL),
    "code_mentions": (code_mentions, CODES_SQL),
    "normalized_vectors": (normalized_vectors, VECTORS_SQL),
    "selected_text": (selected_text, SELECTED_SQL),
}

"""Registered queries over the other tables: validators, reviews, page specifications, JSON, joins with rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import gold as go
from ..operators import intervals as iv
from ..operators import review as rv
from ..operators import validate as va
from ..sources.pages import requested_pages
from .base import LINES_SQL, SPACE, ocr_pages, table


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over several tables' keys."""
    checks = [
        va.duplicates(table(spark, sf_dir, "conversations"), "conv_id", "conversations"),
        va.duplicates(table(spark, sf_dir, "orders"), "o_custkey", "orders"),
        va.duplicates(table(spark, sf_dir, "documents"), "doc_id", "documents"),
        va.duplicates(table(spark, sf_dir, "labels"), "doc_id", "labels"),
    ]
    return va.union(checks)


DUPLICATES_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"check\", {k}::VARCHAR AS id FROM {t} GROUP BY {k} HAVING count(*) > 1" for t, k in (("conversations", "conv_id"), ("orders", "o_custkey"), ("documents", "doc_id"), ("labels", "doc_id"))
)

REFERENCES = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id"), ("lineitem", "l_partkey", "part", "p_partkey")]


def referential_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 both ways, A11, K2: how many keys of a table another one lacks."""
    checks = [va.unmatched(table(spark, sf_dir, a), k, table(spark, sf_dir, b), j, f"{a}-{b}") for a, k, b, j in REFERENCES]
    return va.summary(va.union(checks), [f"{a}-{b}" for a, _, b, _ in REFERENCES]).select("check", "n", "first_id")


REFERENCES_SQL = " UNION ALL ".join(f"SELECT '{a}-{b}' AS \"check\", count(DISTINCT {k}) AS n, min({k}::VARCHAR) AS first_id FROM {a} WHERE {k} NOT IN (SELECT {j} FROM {b})" for a, k, b, j in REFERENCES)


def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up of referential_checks and of a check that finds nothing."""
    found = referential_checks(spark, sf_dir).withColumn("of", F.lit("references"))
    none = va.report(va.duplicates(table(spark, sf_dir, "nation"), "n_nationkey", "nations"), ["nations"])
    both = [va.status(found).withColumn("name", F.lit("references")), va.status(none).withColumn("name", F.lit("nations"))]
    return both[0].unionByName(both[1])


STATUS_SQL = f"SELECT CASE WHEN max(n) > 0 THEN 'fail' ELSE 'pass' END AS status, 'references' AS name FROM ({REFERENCES_SQL}) UNION ALL SELECT CASE WHEN count(*) > count(DISTINCT n_nationkey) THEN 'fail' ELSE 'pass' END, 'nations' FROM nation"


def label_set_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose parts, by their lines, differ as sets from a rule's."""
    lines = table(spark, sf_dir, "lineitem")
    ours = lines.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a"))
    rule = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.sequence(F.lit(1), F.pmod("o_orderkey", F.lit(7)).cast("int") + 1).alias("b"))
    return va.set_disagreements(ours, rule, "l_orderkey", "a", "b", "orders")


DISAGREE_SQL = """
WITH a AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber::INT))) AS s FROM lineitem GROUP BY l_orderkey)
SELECT 'orders' AS "check", l_orderkey::VARCHAR AS id FROM a JOIN orders ON o_orderkey = l_orderkey WHERE s <> list_transform(generate_series(1, o_orderkey % 7 + 1), lambda x: x::INT)
"""


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as review rows of the blocks with their ids."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("block_id"),
        F.col("turn"),
        F.when(F.col("role") == "assistant", "reviewed").otherwise("pending").alias("review_status"),
        F.when(F.col("turn") % 4 == 1, F.concat(F.lit("  fixed "), "conv_id")).otherwise("").alias("corrected_text"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("a > b")).otherwise(" ").alias("corrected_title_path"),
        F.lit("n").alias("review_note"),
    )


def _corrected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), "text", F.array(F.lit("t")).alias("title_path"))
    reviews = _reviews(spark, sf_dir)
    return rv.apply_corrections(blocks, reviews, "turn"), reviews


def first_review_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents corrected by the first reviewed turn of the conversation with their id."""
    out = _corrected(spark, sf_dir)[0].where("correction_applied or size(title_path) > 1")
    return out.select("block_id", F.md5("text").alias("text_md5"), F.md5("original_text").alias("original_md5"), F.array_join("title_path", "|").alias("path"))


def correction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: how many blocks, reviewed items and corrections there are."""
    report = rv.correction_report(*_corrected(spark, sf_dir), "documents", "conversations", "corrected")
    return report.select("original_blocks", "reviewed_items", "corrections_applied", "output_file", F.col("input_files.review_queue").alias("review_queue"), F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$").alias("stamped"))


CORRECTION_SQL = """
WITH r AS (SELECT conv_id, arg_min(turn, turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
d AS (SELECT doc_id, text AS t, turn % 4 = 1 AS fixed, conv_id % 3 = 0 AS moved, conv_id FROM documents JOIN r ON conv_id = doc_id)
SELECT doc_id AS block_id, md5(CASE WHEN fixed THEN 'fixed ' || conv_id ELSE t END) AS text_md5, CASE WHEN fixed THEN md5(t) END AS original_md5, CASE WHEN moved THEN 'a|b' ELSE 't' END AS path FROM d WHERE fixed OR moved
"""


REPORT_SQL = """
WITH r AS (SELECT conv_id, arg_min(turn, turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT (SELECT count(*) FROM documents) AS original_blocks, (SELECT count(*) FROM conversations WHERE role = 'assistant') AS reviewed_items,
       (SELECT count(*) FROM documents JOIN r ON conv_id = doc_id WHERE turn % 4 = 1) AS corrections_applied, 'corrected' AS output_file, 'conversations' AS review_queue, true AS stamped
"""


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 over a plain and over an exploded column."""
    docs = table(spark, sf_dir, "documents")
    langs = va.value_counts(docs, F.col("lang")).withColumn("kind", F.lit("lang"))
    words = va.value_counts(docs, F.explode(F.split("text", " "))).withColumn("kind", F.lit("word"))
    return langs.unionByName(words)


COUNTS_SQL = "SELECT lang AS value, count(*) AS n, 'lang' AS kind FROM documents GROUP BY lang UNION ALL SELECT w, count(*), 'word' FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1"


def page_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages named by specifications made from the nation table, some of them reversed."""
    k = F.col("n_nationkey")
    spec = F.concat((k + 3).cast("string"), F.lit(", "), (k + 1).cast("string"), F.lit("-"), (k % 5 + 4).cast("string"), F.lit(",,"), (k + 3).cast("string"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", requested_pages(spec, strict=False).alias("pages"))
    return rows.select("n_nationkey", F.posexplode("pages").alias("pos", "page")).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("pos").cast("long").alias("pos"), F.col("page").cast("long").alias("page"))


PAGES_SQL = """
WITH s AS (SELECT n_nationkey AS k, [n_nationkey + 3] || list_filter(generate_series(n_nationkey + 1, n_nationkey % 5 + 4), lambda x: x <> n_nationkey + 3) AS pages FROM nation)
SELECT k::BIGINT AS n_nationkey, (generate_subscripts(pages, 1) - 1)::BIGINT AS pos, unnest(pages)::BIGINT AS page FROM s
"""


def strict_page_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 over specifications that it accepts: order kept, each page once, empty parts skipped."""
    k = F.col("n_nationkey")
    spec = F.concat(F.lit(" "), (k + 2).cast("string"), F.lit(" ,"), (k % 4 + 1).cast("string"), F.lit("-"), (k + 5).cast("string"), F.lit(", ,"), (k + 9).cast("string"), F.lit("-"), (k + 9).cast("string"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(requested_pages(spec)).alias("pos", "page"))
    return rows.select(*[F.col(c).cast("long").alias(c) for c in rows.columns])


STRICT_SQL = """
WITH s AS (SELECT n_nationkey AS k, [n_nationkey + 2] || list_filter(generate_series(n_nationkey % 4 + 1, n_nationkey + 5), lambda x: x <> n_nationkey + 2) || [n_nationkey + 9] AS pages FROM nation)
SELECT k::BIGINT AS n_nationkey, (generate_subscripts(pages, 1) - 1)::BIGINT AS pos, unnest(pages)::BIGINT AS page FROM s
"""


def last_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary rule of the joins: of rows with one key, the last counts; missing partners would fail."""
    last = go.last_by(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", F.col("o_orderkey"))
    joined = go.join_required(last, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "o_custkey", "c_custkey", "customer")
    return joined.select("o_custkey", "o_orderkey", "c_mktsegment")


LAST_SQL = "SELECT o_custkey, max(o_orderkey) AS o_orderkey, any_value(c_mktsegment) AS c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey"


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F15, H5, H10, H11, H12 over the whole lines of documents' pages."""
    texts = F.posexplode(F.col("results")[0]["rec_texts"]).alias("pos", "line")
    lines = ocr_pages(spark, sf_dir).select("document_id", texts).join(table(spark, sf_dir, "documents").select(F.concat(F.lit("D"), "doc_id").alias("document_id"), "doc_id", "lang", "source"), "document_id")
    weights = F.create_map(F.lit("en"), F.lit(1), F.lit("fr"), F.lit(2))
    pages = F.array(*[F.pmod(F.col("doc_id") + F.col("pos"), F.lit(k)).cast("int") for k in (4, 3, 2)])
    return lines.select(
        "doc_id",
        (F.col("pos") + 1).alias("line_index"),
        F.md5(tx.normalize(F.col("line"))).alias("normalized_md5"),
        tx.is_code(F.col("line")).alias("code"),
        tx.han_count(F.col("line")).alias("han"),
        tx.first_filled(F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang")), F.col("source")).alias("filled"),
        tx.lookup(weights, F.col("lang"), F.lit(9)).alias("weight"),
        tx.page_label(pages).alias("label"),
        F.array_join(F.array("lang", "source"), "|").alias("joined"),
    )


SCALARS_SQL = rf"""
WITH {LINES_SQL},
d AS (SELECT r.*, lang, source, [(doc_id + line_index - 1) % 4, (doc_id + line_index - 1) % 3, (doc_id + line_index - 1) % 2] AS p FROM raw_lines r JOIN documents USING (doc_id))
SELECT doc_id, line_index::INT AS line_index, md5(trim(regexp_replace(raw, '{SPACE}+', ' ', 'g'))) AS normalized_md5,
       regexp_matches(raw, '(?i)(?:^|{SPACE})(?:N\d+)?{SPACE}*(?:G\d{{1,3}}|M\d{{1,3}}|[XYZUWRIJKFPQSDT][-+]?\d)') AND len(regexp_extract_all(raw, '[一-鿿]')) <= 4 AS code, len(regexp_extract_all(raw, '[一-鿿]'))::INT AS han,
       CASE WHEN lang = 'en' THEN source ELSE lang END AS filled, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 9 END::INT AS weight,
       CASE WHEN p[1] = p[2] AND p[2] = p[3] THEN '第' || p[1] || '页' ELSE '第' || p[1] || '—' || CASE WHEN p[3] NOT IN (p[1], p[2]) THEN p[3] WHEN p[2] <> p[1] THEN p[2] ELSE p[3] END || '页' END AS label, lang || '|' || source AS joined
FROM d
"""

def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, J10 in general: spans of documents and of pages that overlap, of the same group of five; lengths go from one to
    the documents' sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("g"), F.col("doc_id").alias("a"), (F.col("doc_id") + F.col("n_chars") % 97).alias("b"))
    pages = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 5).alias("g"), (F.col("page_id") * 4).alias("a"), (F.col("page_id") * 4 + F.length("html") % F.when(F.col("page_id") % 50 == 0, 4000).otherwise(20)).alias("b"))
    met = iv.interval_join(docs, pages, ("a", "b"), ("a", "b"), ("g",))
    return met.select("left.doc_id", "right.page_id", F.greatest("left.a", "right.a").alias("first"), (F.least("left.b", "right.b") - F.greatest("left.a", "right.a") + 1).alias("shared"))


SPANS_SQL = """
WITH d AS (SELECT doc_id, doc_id % 5 AS g, doc_id AS a, doc_id + n_chars % 97 AS b FROM documents),
p AS (SELECT page_id, page_id % 5 AS g, page_id * 4 AS a, page_id * 4 + length(html) % CASE WHEN page_id % 50 = 0 THEN 4000 ELSE 20 END AS b FROM pages)
SELECT doc_id, page_id, greatest(d.a, p.a) AS first, least(d.b, p.b) - greatest(d.a, p.a) + 1 AS shared FROM d JOIN p ON d.g = p.g AND d.a <= p.b AND p.a <= d.b
"""

QUERIES = {
    "overlapping_spans": (overlapping_spans, SPANS_SQL),
    "duplicate_keys": (duplicate_keys, DUPLICATES_SQL),
    "referential_checks": (referential_checks, REFERENCES_SQL),
    "validation_status": (validation_status, STATUS_SQL),
    "label_set_disagreement": (label_set_disagreement, DISAGREE_SQL),
    "first_review_correction": (first_review_correction, CORRECTION_SQL),
    "correction_report": (correction_report, REPORT_SQL),
    "value_counts": (value_counts, COUNTS_SQL),
    "page_spec": (page_spec, PAGES_SQL),
    "strict_page_spec": (strict_page_spec, STRICT_SQL),
    "last_by_key": (last_by_key, LAST_SQL),
    "text_scalars": (text_scalars, SCALARS_SQL),
}

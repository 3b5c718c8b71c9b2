"""Registered queries that write files and read them back: JSON lines, CSV, reports, page files, hashes, manifests.

Each reads its files into a report of a few rows, which is what it returns; the files go before that.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as bl
from ..operators import chunks as ch
from ..operators import validate as va
from ..sources import files, jsonl, pages, publish
from .base import line_blocks, ocr_pages, table
from .documents import BATCH_SQL, FIXED_SQL

EVENT = "event_id BIGINT, event_type STRING, value DOUBLE, props STRING"
BAD = ["Average score: 0.5", "", "  \t", "[1, 2]", '{"event_id": 1', "Average score: 1"]


def _report(spark: SparkSession, found: DataFrame, path: str) -> DataFrame:
    """The rows of a report, which are a handful, without the files that they come from."""
    rows = found.collect()
    files.remove_folder(spark, path)
    return spark.createDataFrame(rows, found.schema)


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines; read strictly behind a legacy footer, leniently with lines that are no
    objects, and those lines listed."""
    path = files.scratch_folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"), "props")
    lines = lambda some: spark.createDataFrame([(x,) for x in some], "value string").coalesce(1)
    for name, some in (("sound", BAD[:3]), ("bad", BAD)):
        jsonl.write_jsonl(events, f"{path}/{name}")
        lines(some).write.mode("append").text(f"{path}/{name}")
    lines(BAD).write.text(f"{path}/few")
    total = lambda df: (F.count("*").alias("n"), F.count("event_id").alias("objects"), F.count("value").alias("filled"), F.sum(F.from_json("props", "k int")["k"]).alias("k"))
    strict = jsonl.read_jsonl_strict(spark, f"{path}/sound", EVENT, allow_legacy_footer=True)
    lenient = jsonl.read_jsonl(spark, f"{path}/bad", EVENT)
    none = F.lit(None).cast("bigint")
    checked = [
        jsonl.check_jsonl(spark, f"{path}/few", footer).groupBy("problem").agg(F.count("*").alias("n"), F.min("line_number").alias("objects"), F.max("line_number").alias("filled")).select(F.concat(F.lit(name), "problem").alias("part"), "n", F.col("objects").cast("bigint"), F.col("filled").cast("bigint"), none.alias("k"))
        for name, footer in (("any: ", False), ("with footer: ", True))
    ]
    found = strict.agg(*total(strict)).select(F.lit("strict").alias("part"), "*").unionByName(lenient.agg(*total(lenient)).select(F.lit("lenient").alias("part"), "*"))
    return _report(spark, found.unionByName(checked[0]).unionByName(checked[1]), path)


JSONL_SQL = """
WITH e AS (SELECT count(*) AS n, count(*) FILTER (event_id % 10 <> 0 AND value IS NOT NULL) AS filled, sum((props->>'k')::BIGINT)::BIGINT AS k FROM events)
SELECT 'strict' AS part, n, n AS objects, filled, k FROM e UNION ALL SELECT 'lenient', n + 4, n, filled, k FROM e
UNION ALL VALUES ('any: invalid JSON', 3, 1, 6, NULL), ('any: expected a JSON object', 1, 4, 4, NULL), ('with footer: invalid JSON', 1, 5, 5, NULL), ('with footer: expected a JSON object', 1, 4, 4, NULL)
"""


def review_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with quotes, commas, separators and line breaks, with and without a byte order mark."""
    path = files.scratch_folder(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("block_id"), F.concat(F.lit('say "'), "text", F.lit('", and\n; | ')).alias("corrected_text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("review_note"))
    found = None
    for mark in (True, False):
        jsonl.write_review_csv(docs, f"{path}/{mark}", mark)
        read = jsonl.read_review_csv(spark, f"{path}/{mark}")
        both = read.select("block_id", F.col("corrected_text").alias("t"), F.col("review_note").alias("r")).join(docs, "block_id")
        same = F.col("t").eqNullSafe(F.col("corrected_text"))
        part = both.agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.count_if(F.col("r") == "").alias("empty"), F.max(F.md5("t")).alias("last_md5")).select(F.lit(mark).alias("mark"), F.lit("|".join(read.columns)).alias("columns"), "*")
        found = part if found is None else found.unionByName(part)
    return _report(spark, found, path)


CSV_SQL = """
SELECT mark, 'block_id|corrected_text|review_note' AS columns, count(*) AS n, count(*) AS same, count(*) FILTER (doc_id % 2 <> 0) AS empty, max(md5('say "' || text || '", and' || chr(10) || '; | ')) AS last_md5
FROM documents CROSS JOIN (VALUES (true), (false)) m(mark) GROUP BY mark
"""


def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as JSON, with the exit code that each gives."""
    path = files.scratch_folder(spark)
    found = None
    for name, key, names in (("labels", "doc_id", ["labels", "nothing"]), ("orders", "o_custkey", ["orders"]), ("nation", "n_nationkey", ["nation"])):
        report = va.report(va.duplicates(table(spark, sf_dir, name), key, name), names)
        code = jsonl.write_report(report, f"{path}/{name}")
        read = jsonl.read_jsonl_strict(spark, f"{path}/{name}", "check STRING, n BIGINT, ids ARRAY<STRING>")
        part = read.select("check", "n", F.size("ids").alias("n_ids"), F.lit(code).alias("code"))
        found = part if found is None else found.unionByName(part)
    return _report(spark, found, path)


def _report_sql(name: str, key: str) -> str:
    d = f"(SELECT {key} FROM {name} GROUP BY {key} HAVING count(*) > 1)"
    return f"SELECT '{name}' AS \"check\", count(*) AS n, count(*)::INT AS n_ids, (count(*) > 0)::INT AS code FROM {d}"


REPORTS_SQL = " UNION ALL ".join([_report_sql("labels", "doc_id"), _report_sql("orders", "o_custkey"), _report_sql("nation", "n_nationkey"), f"SELECT 'nothing', 0, 0, code FROM ({_report_sql('labels', 'doc_id')})"])


def hashes_and_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and hashes of files, and the manifest that names them."""
    path = files.scratch_folder(spark)
    for name, key, column in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        table(spark, sf_dir, name).coalesce(1).sortWithinPartitions(key).select(column).write.text(f"{path}/{name}")
    nation, region = (files.file_hashes(spark, f"{path}/{n}").where(F.col("file").startswith("part-")) for n in ("nation", "region"))
    profiles = nation.select(F.lit("fixed").alias("profile"), "file", F.lit(25).alias("chunk_count"))
    one = files.manifest(profiles, nation, region, region)
    fixed = F.col("profiles")["fixed"]
    rows = one.select(F.lit("manifest").alias("part"), fixed["report"]["chunk_count"].cast("bigint").alias("bytes"), fixed["sha256"].alias("sha256"), F.col("source.sha256").alias("source_sha256"), "status", "version")
    none = F.lit(None).cast("string")
    for name, df in (("nation", nation), ("region", region)):
        rows = rows.unionByName(df.select(F.lit(name).alias("part"), "bytes", "sha256", none.alias("source_sha256"), none.alias("status"), none.alias("version")))
    return _report(spark, rows, path)


HASHES_SQL = """
WITH n AS (SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS t FROM nation), r AS (SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS t FROM region)
SELECT 'nation' AS part, strlen(t) AS bytes, sha256(t) AS sha256, NULL AS source_sha256, NULL AS status, NULL AS version FROM n UNION ALL SELECT 'region', strlen(t), sha256(t), NULL, NULL, NULL FROM r
UNION ALL SELECT 'manifest', 25, sha256(n.t), sha256(r.t), 'draft_not_for_final_thesis_experiment', '0.2-draft' FROM n CROSS JOIN r
"""

PAGES_PER_FILE = 100


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JSON files with a build configuration beside them, and the summary of all."""
    path = files.scratch_folder(spark)
    made = ocr_pages(spark, sf_dir)
    number = F.floor(F.substring("document_id", 2, 20).cast("long") / PAGES_PER_FILE).alias("file")
    arrays = made.select(number, F.struct(*made.columns).alias("page")).groupBy("file").agg(F.to_json(F.collect_list("page")).alias("value"))
    arrays.write.partitionBy("file").text(f"{path}/pages")
    config = {"document_id": "D", "batch_id": "b1", "pdf_pages": [1, 2, 9], "initial_title_paths": {"1-2": ["one"], "2": ["two"], "9": ["nine"]}, "note": "left alone"}
    spark.createDataFrame([(json.dumps(config, indent=1),)], "value string").coalesce(1).write.text(f"{path}/config")
    read = pages.read_build_config(spark, f"{path}/config")
    paths = pages.page_paths(spark, read.initial_title_paths).agg(F.array_join(F.array_sort(F.collect_list(F.concat("pdf_page", F.lit("="), F.get("title_path", F.lit(0))))), ",").alias("paths"))
    summary = bl.ocr_batch_summary(bl.ocr_page_summary(bl.read_ocr_pages(spark, f"{path}/pages")))
    row = summary.select("page_count", F.size("empty_pages").alias("n_empty"), "total_lines", "total_characters", F.round("weighted_average_confidence", 3).alias("weighted_confidence"), "total_elapsed_seconds", "average_elapsed_seconds_per_page")
    return _report(spark, row.crossJoin(paths).withColumn("batch_id", F.lit(read.batch_id)), path)


PAGE_FILES_SQL = f"SELECT *, '1=one,2=two,9=nine' AS paths, 'b1' AS batch_id FROM ({BATCH_SQL})"

def published_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K6: blocks and fixed windows published as a version, whose chunks are read back by the manifest and verified. The store
    goes once they are copied."""
    root = files.scratch_folder(spark)
    stages = [
        publish.Stage("blocks", lambda s, _: line_blocks(s, sf_dir)),
        publish.Stage("chunks", lambda s, made: ch.fixed_windows(made["blocks"]), "350/70"),
    ]
    publish.publish(spark, root, "v1", stages, {"tables": "documents"})
    chunks = publish.read_version(spark, root, "v1", "chunks", verify=True)
    found = files.durable(chunks.select("chunk_id", "character_count", F.size("source_block_ids").alias("n_blocks"), F.md5("text").alias("text_md5"), F.md5("retrieval_text").alias("retrieval_md5")))
    files.remove_folder(spark, root)
    return found


QUERIES = {
    "published_chunks": (published_chunks, FIXED_SQL),
    "jsonl_round_trip": (jsonl_round_trip, JSONL_SQL),
    "review_csv_round_trip": (review_csv_round_trip, CSV_SQL),
    "report_round_trip": (report_round_trip, REPORTS_SQL),
    "hashes_and_manifest": (hashes_and_manifest, HASHES_SQL),
    "page_files": (page_files, PAGE_FILES_SQL),
}

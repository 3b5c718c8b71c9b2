"""Registered queries over documents as pages of lines: blocks, chunks, summaries, gold labels, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as bl
from ..operators import chunks as ch
from ..operators import gold as go
from ..operators import review as rv
from ..operators import row_folds as rf
from ..operators import validate as va
from ..sources.files import durable
from .base import LINES_SQL, as_blocks, line_blocks, line_rows, ocr_lines, ocr_pages, table


def line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 arrays, F1, F3, F13, H5: the kind of every line."""
    lines = ocr_lines(spark, sf_dir)
    return lines.select("source_line_id", F.col("type"), F.length("text").alias("characters"))


CLASSIFY_SQL = f"""WITH {LINES_SQL}
SELECT format('{{}}_P{{:03d}}_L{{:03d}}', document_id, pdf_page, line_index) AS source_line_id, type, length(text)::INT AS characters FROM typed"""


def line_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue flags counted over all lines."""
    from ..functions import text as tx

    lines = ocr_lines(spark, sf_dir)
    flags = tx.line_issues(F.col("text"), F.col("type"), F.col("score"), F.col("layout_region"))
    return va.value_counts(lines, F.explode(flags)).select(F.col("value").alias("issue"), "n")


REGIONS_SQL = f"""{LINES_SQL},
marked AS (
  SELECT *, type = 'caption' AND text LIKE '表%' AS opens, type IN ('heading', 'subheading', 'exercise_heading', 'caption') AS stops,
         sum((type = 'caption' AND text LIKE '表%')::INT) OVER (PARTITION BY doc_id ORDER BY line_index) AS seg FROM typed),
regions AS (
  SELECT *, CASE WHEN seg > 0 AND row_number() OVER w <= 30 AND sum((stops AND NOT opens)::INT) OVER w = 0 THEN 'table_candidate' END AS region
  FROM marked WINDOW w AS (PARTITION BY doc_id, seg ORDER BY line_index))"""

ISSUES_SQL = f"""WITH {REGIONS_SQL},
flags AS (
  SELECT unnest([CASE WHEN score < 0.85 THEN 'low_confidence' END, CASE WHEN regexp_matches(text, '(?:GOO|执加|进考虑|平选择关|中轨迹|建刀具|第章|第③章)') THEN 'possible_ocr_confusion' END,
    CASE WHEN opens THEN 'table_layout_requires_review' WHEN region = 'table_candidate' THEN 'inside_table_candidate' END,
    CASE WHEN type = 'header_footer' AND contains(text, '第章') THEN 'header_chapter_number_missing' END]) AS issue FROM regions)
SELECT issue, count(*) AS n FROM flags WHERE issue IS NOT NULL GROUP BY issue"""


def table_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inside and outside table regions, per document and kind."""
    return ocr_lines(spark, sf_dir).groupBy("document_id", "type").agg(F.count("layout_region").alias("inside"), F.count("*").alias("n_lines"))


REGION_SQL = f"WITH {REGIONS_SQL} SELECT document_id, type, count(region) AS inside, count(*) AS n_lines FROM regions GROUP BY ALL"


def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every document with their line counts, sizes and confidences."""
    from ..sources.pages import page_paths

    paths = page_paths(spark, {"1-100": ["start"]})
    blocks = bl.build_blocks(ocr_pages(spark, sf_dir), paths, {}, "batch")
    return blocks.select("block_id", "block_type", F.size("source_line_ids").alias("n_lines"), F.length("text").alias("characters"), "average_confidence")


MERGE_SQL = f"""WITH RECURSIVE {LINES_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS n, regexp_matches(text, '[。！？；：]$') AS ended FROM typed),
fold AS (
  SELECT doc_id, n, 1 AS no, length(text) AS size, type = 'paragraph' AND NOT ended AS open_ FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.doc_id, x.n, CASE WHEN f.open_ AND x.type = 'paragraph' AND f.size + length(x.text) <= 260 THEN f.no ELSE f.no + 1 END,
         CASE WHEN f.open_ AND x.type = 'paragraph' AND f.size + length(x.text) <= 260 THEN f.size + length(x.text) ELSE length(x.text) END, x.type = 'paragraph' AND NOT x.ended
  FROM fold f JOIN numbered x ON x.doc_id = f.doc_id AND x.n = f.n + 1)
SELECT format('{{}}_P{{:03d}}_B{{:03d}}', document_id, pdf_page, no) AS block_id, arg_min(type, n) AS block_type, count(*)::INT AS n_lines, sum(length(text))::INT AS characters, round(avg(round(score, 6)), 6) AS average_confidence
FROM fold JOIN numbered USING (doc_id, n) GROUP BY document_id, pdf_page, no"""


def title_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title path that holds at every line."""
    lines = ocr_lines(spark, sf_dir)
    return lines.select("source_line_id", F.array_join("title_path", " > ").alias("path"))


TITLE_SQL = rf"""WITH RECURSIVE {LINES_SQL},
heads AS (
  SELECT *, regexp_extract(text, '^(\d+(?:\.\d+){{1,2}})', 1) AS number, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS n FROM typed),
parts AS (
  SELECT *, CASE WHEN split_part(number, '.', 1) = '1' THEN 'Chapter one' ELSE '第' || split_part(number, '.', 1) || '章' END AS title,
         regexp_replace(number, '\.[^.]*$', '') AS parent, len(string_split(number, '.')) = 3 AS deep FROM heads),
fold AS (
  SELECT doc_id, 0::BIGINT AS n, ['start'] AS path FROM typed GROUP BY doc_id
  UNION ALL
  SELECT f.doc_id, x.n, CASE WHEN x.type <> 'heading' THEN f.path WHEN x.deep THEN [x.title, coalesce(list_filter(f.path, lambda p: starts_with(p, x.parent || ' '))[1], x.parent), x.text] ELSE [x.title, x.text] END
  FROM fold f JOIN parts x ON x.doc_id = f.doc_id AND x.n = f.n + 1)
SELECT format('{{}}_P{{:03d}}_L{{:03d}}', document_id, pdf_page, line_index) AS source_line_id, array_to_string(path, ' > ') AS path FROM fold JOIN parts USING (doc_id, n)"""


def ocr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, H4, H6."""
    rows = bl.ocr_page_summary(ocr_pages(spark, sf_dir))
    return rows.select("document_id", "line_count", "character_count", "average_confidence", "minimum_confidence", "code_count", F.size("low_confidence_lines").alias("n_low"), "replacement_character_count")


SUMMARY_SQL = rf"""WITH {LINES_SQL},
scores AS (SELECT doc_id, round(avg(((doc_id * 31 + (line_index - 1) * 17) % 1000) / 1000.0::DOUBLE), 4) AS average_confidence, round(min(((doc_id * 31 + (line_index - 1) * 17) % 1000) / 1000.0::DOUBLE), 4) AS minimum_confidence FROM raw_lines GROUP BY doc_id),
kept AS (SELECT r.doc_id, count(*)::INT AS line_count, (sum(length(raw)) + count(*) - 1)::INT AS character_count, string_agg(raw, chr(10) ORDER BY r.line_index) AS joined,
           count(*) FILTER (score < 0.8)::INT AS n_low FROM raw_lines r JOIN lines l USING (doc_id, line_index) GROUP BY r.doc_id)
SELECT 'D' || doc_id AS document_id, coalesce(line_count, 0) AS line_count, coalesce(character_count, 0) AS character_count, average_confidence, minimum_confidence,
       coalesce(len(list_distinct(list_transform(regexp_extract_all(regexp_replace(' ' || joined, '([A-Za-z]+)', ' \1', 'g'), '(?i)[^A-Za-z]([GMTFSXYZIJKRPQ]\s*[+-]?\d+(?:\.\d+)?)', 1), lambda x: replace(x, ' ', ''))))::INT, 0) AS code_count,
       coalesce(n_low, 0) AS n_low, coalesce(length(joined) - length(replace(joined, chr(65533), '')), 0)::INT AS replacement_character_count
FROM scores LEFT JOIN kept USING (doc_id)"""


def ocr_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over all pages."""
    row = bl.ocr_batch_summary(bl.ocr_page_summary(ocr_pages(spark, sf_dir)))
    return row.select("page_count", F.size("empty_pages").alias("n_empty"), "total_lines", "total_characters", F.round("weighted_average_confidence", 3).alias("weighted_confidence"), "total_elapsed_seconds", "average_elapsed_seconds_per_page")


BATCH_SQL = f"""WITH per_page AS ({SUMMARY_SQL}), seconds AS (SELECT sum((doc_id % 7) / 2.0::DOUBLE) AS s FROM documents)
SELECT count(*) AS page_count, count(*) FILTER (line_count = 0)::INT AS n_empty, sum(line_count)::BIGINT AS total_lines, sum(character_count)::BIGINT AS total_characters,
       round(sum(average_confidence * line_count) FILTER (line_count > 0) / sum(line_count), 3) AS weighted_confidence, round(max(s), 3) AS total_elapsed_seconds, round(max(s) / count(*), 3) AS average_elapsed_seconds_per_page
FROM per_page CROSS JOIN seconds"""


def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character windows with their text and number of source blocks."""
    chunks = ch.fixed_windows(line_blocks(spark, sf_dir))
    return chunks.select("chunk_id", "character_count", F.size("source_block_ids").alias("n_blocks"), F.md5("text").alias("text_md5"), F.md5("retrieval_text").alias("retrieval_md5"))


WINDOWS_SQL = f"""{LINES_SQL},
usable AS (SELECT *, length(text) + 1 AS size FROM typed WHERE type <> 'header_footer'),
spans AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY line_index) AS r, sum(size) OVER (PARTITION BY doc_id ORDER BY line_index) - size AS l FROM usable),
whole AS (SELECT doc_id, string_agg(text || chr(10), '' ORDER BY line_index) AS t, sum(size)::BIGINT AS n FROM usable GROUP BY doc_id),
starts AS (SELECT doc_id, t, unnest(generate_series(0, CASE WHEN n <= 350 THEN 0 ELSE (n - 350 + 279) // 280 END)) AS k FROM whole),
cut AS (SELECT doc_id, k, trim(substring(t, k * 280 + 1, 350), ' ' || chr(10)) AS text FROM starts),
named AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM cut WHERE text <> ''),
sources AS (SELECT c.doc_id, c.n, c.text, s.line_index, 'start > part ' || (s.line_index // 10) AS path, s.document_id, s.pdf_page, greatest(s.l, c.k * 280) - s.l AS lo, least(s.r - 1, c.k * 280 + 350) - s.l AS hi, s.size - 1 AS chars
            FROM named c JOIN spans s ON s.doc_id = c.doc_id AND s.l < c.k * 280 + 350 AND s.r > c.k * 280)"""

FIXED_SQL = f"""WITH {WINDOWS_SQL}
SELECT format('{{}}_FIXED_V01_C{{:04d}}', document_id, n) AS chunk_id, length(any_value(text))::INT AS character_count, count(*)::INT AS n_blocks, md5(any_value(text)) AS text_md5, md5(arg_min(path, line_index) || chr(10) || any_value(text)) AS retrieval_md5
FROM sources GROUP BY document_id, n"""


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of token windows of 256 with 51 in common; tokens are runs without spaces."""
    chunks = ch.fixed_token_windows(line_blocks(spark, sf_dir), tokens=ch.Tokens(r"\S+"))
    each = chunks.select("chunk_id", "token_count", F.explode("source_fragments").alias("f"))
    return each.select("chunk_id", "token_count", "f.block_id", F.col("f.block_character_start").alias("lo"), F.col("f.block_character_end").alias("hi"), F.col("f.coverage").alias("coverage"))


TOKENS_SQL = f"""WITH {LINES_SQL},
usable AS (SELECT doc_id, document_id, line_index, text, regexp_extract_all(text, '\\S+') AS toks FROM typed WHERE type <> 'header_footer'),
toks AS (SELECT doc_id, document_id, line_index, length(text) AS chars, unnest(toks) AS tok, generate_subscripts(toks, 1) AS j FROM usable),
placed AS (SELECT *, sum(length(tok) + 1) OVER (PARTITION BY doc_id, line_index ORDER BY j) - 1 AS e, row_number() OVER (PARTITION BY doc_id ORDER BY line_index, j) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM toks),
win AS (SELECT DISTINCT doc_id, unnest(generate_series(0, CASE WHEN n <= 256 THEN 0 ELSE (n - 256 + 204) // 205 END)) AS k FROM placed),
hits AS (SELECT w.k, p.*, p.e - length(p.tok) AS s FROM win w JOIN placed p ON p.doc_id = w.doc_id AND p.p >= w.k * 205 AND p.p < w.k * 205 + 256),
f AS (SELECT document_id, k, line_index, min(s)::INT AS lo, max(e)::INT AS hi, any_value(chars) AS chars, count(*) AS c FROM hits GROUP BY ALL)
SELECT format('{{}}_FIXED_T256_O51_V02_C{{:04d}}', document_id, k + 1) AS chunk_id, sum(c) OVER (PARTITION BY document_id, k)::INT AS token_count, format('{{}}_B{{:05d}}', document_id, line_index) AS block_id, lo, hi, round((hi - lo)::DOUBLE / chars, 6) AS coverage FROM f"""


def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks along titles, headings and regions, by characters."""
    chunks = ch.structural_chunks(line_blocks(spark, sf_dir))
    return chunks.select("chunk_id", "character_count", F.size("source_block_ids").alias("n_blocks"), F.md5("text").alias("text_md5"))


def _runs_sql(size: str, joined: int, most: int) -> str:
    """blocks in runs (run 1, 2, ...): a run ends before a boundary and before it would outgrow `most`."""
    return f"""{REGIONS_SQL},
units AS (
  SELECT doc_id, document_id, line_index, text, type IN ('heading', 'subheading', 'exercise_heading') AS heading, coalesce(region, '') AS region, line_index // 10 AS path,
         {size} AS size, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS n FROM regions WHERE type <> 'header_footer'),
bounded AS (
  SELECT *, n > 1 AND (heading OR path <> lag(path) OVER w OR region <> lag(region) OVER w) AS boundary FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
cut AS (
  SELECT doc_id, n, 1 AS run, size + {joined} AS held FROM bounded WHERE n = 1
  UNION ALL
  SELECT b.doc_id, b.n, CASE WHEN b.boundary OR c.held + b.size > {most} THEN c.run + 1 ELSE c.run END, CASE WHEN b.boundary OR c.held + b.size > {most} THEN b.size + {joined} ELSE c.held + b.size + {joined} END
  FROM cut c JOIN bounded b ON b.doc_id = c.doc_id AND b.n = c.n + 1),
blocks AS (SELECT * FROM cut JOIN bounded USING (doc_id, n)),
runs AS (
  SELECT doc_id, run, sum(size + {joined}) AS w, bool_and(heading) AS headings, arg_min(path, n) AS first_path, arg_max(path, n) AS last_path, max(run) OVER (PARTITION BY doc_id) AS n_runs FROM blocks GROUP BY doc_id, run)"""


STRUCTURAL_SQL = f"""WITH RECURSIVE {_runs_sql("length(text)", 1, 600)},
fold AS (
  SELECT doc_id, 0::BIGINT AS run, 0::HUGEINT AS held, 0 AS done, 0::HUGEINT AS last_w, 0 AS chunk FROM runs WHERE run = 1
  UNION ALL
  SELECT doc_id, run, CASE WHEN waits THEN now ELSE 0 END, CASE WHEN waits OR joins THEN done ELSE done + 1 END, CASE WHEN waits OR joins THEN last_w ELSE now END, done + 1
  FROM (SELECT f.doc_id, r.run, f.held + r.w AS now, f.done, f.last_w, f.held + r.w < 80 AND r.run < r.n_runs AS waits,
               f.held + r.w < 80 AND r.run = r.n_runs AND f.done > 0 AND f.last_w + f.held + r.w <= 600 AS joins
        FROM fold f JOIN runs r ON r.doc_id = f.doc_id AND r.run = f.run + 1)),
numbered AS (SELECT doc_id, run, least(chunk, max(done) OVER (PARTITION BY doc_id)) AS chunk FROM fold WHERE run > 0),
texts AS (SELECT document_id, chunk, count(*)::INT AS n_blocks, string_agg(text, chr(10) ORDER BY n) AS text FROM blocks JOIN numbered USING (doc_id, run) GROUP BY document_id, chunk)
SELECT format('{{}}_STRUCT_V01_C{{:04d}}', document_id, chunk) AS chunk_id, length(text)::INT AS character_count, n_blocks, md5(text) AS text_md5 FROM texts"""


def structural_token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As structural_chunks by tokens, which are runs without spaces."""
    chunks = ch.structural_token_chunks(line_blocks(spark, sf_dir), tokens=ch.Tokens(r"\S+"))
    return chunks.select("chunk_id", "token_count", F.size("source_block_ids").alias("n_blocks"), F.md5("text").alias("text_md5"))


def row_table_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 over rows; they carry what is asked for and the first sign of their texts, which tells a table's caption."""
    lines = line_rows(spark, sf_dir).select("document_id", "pdf_page", "line_index", "type", F.left("text", F.lit(1)).alias("text"))
    return rf.table_regions(lines).groupBy("document_id", "type").agg(F.count("layout_region").alias("inside"), F.count("*").alias("n_lines"))


def row_title_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 over rows."""
    initial = spark.range(1, 101).select(F.col("id").cast("int").alias("pdf_page"), F.array(F.lit("start")).alias("initial_path"))
    heading = F.when(F.col("type") == "heading", F.col("text")).alias("text")  # paths need no other texts
    lines = rf.title_paths(line_rows(spark, sf_dir).select("document_id", "pdf_page", "line_index", "source_line_id", "type", heading), initial, {"1": "Chapter one"})
    return lines.select("source_line_id", F.array_join("title_path", " > ").alias("path"))


def row_paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 over rows."""
    blocks = rf.paragraph_blocks(line_rows(spark, sf_dir))
    return blocks.select("block_id", "block_type", F.size("source_line_ids").alias("n_lines"), F.length("text").alias("characters"), "average_confidence")


def _row_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_blocks(rf.table_regions(line_rows(spark, sf_dir)))


def row_structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 over rows."""
    chunks = rf.structural_chunks(_row_blocks(spark, sf_dir))
    return chunks.select("chunk_id", "character_count", F.size("source_block_ids").alias("n_blocks"), F.md5("text").alias("text_md5"))


def row_structural_token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 over rows."""
    chunks = rf.structural_token_chunks(_row_blocks(spark, sf_dir), tokens=ch.Tokens(r"\S+"))
    return chunks.select("chunk_id", "token_count", F.size("source_block_ids").alias("n_blocks"), F.md5("text").alias("text_md5"))


TOKEN_COUNT = r"len(regexp_extract_all(text, '\S+'))"
TOKEN_CHUNKS = f"""{_runs_sql(TOKEN_COUNT, 0, 512)},
fold AS (
  SELECT doc_id, 1::BIGINT AS run, 1 AS chunk, w AS last_w, last_path FROM runs WHERE run = 1
  UNION ALL
  SELECT f.doc_id, r.run, CASE WHEN r.w < 64 AND (r.first_path = f.last_path OR r.headings) AND f.last_w + r.w <= 512 THEN f.chunk ELSE f.chunk + 1 END,
         CASE WHEN r.w < 64 AND (r.first_path = f.last_path OR r.headings) AND f.last_w + r.w <= 512 THEN f.last_w + r.w ELSE r.w END, r.last_path
  FROM fold f JOIN runs r ON r.doc_id = f.doc_id AND r.run = f.run + 1),
chunks AS (
  SELECT document_id, chunk, sum(size)::INT AS token_count, count(*)::INT AS n_blocks, string_agg(text, chr(10) ORDER BY n) AS text, list(line_index) AS lines FROM blocks JOIN fold USING (doc_id, run) GROUP BY document_id, chunk)"""

STRUCTURAL_TOKENS_SQL = f"""WITH RECURSIVE {TOKEN_CHUNKS}
SELECT format('{{}}_STRUCTURAL_T512_V02_C{{:04d}}', document_id, chunk) AS chunk_id, token_count, n_blocks, md5(text) AS text_md5 FROM chunks"""


def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 over fixed windows."""
    row = ch.profile_report(ch.fixed_windows(line_blocks(spark, sf_dir)))
    return row.select("strategy", "chunk_count", "average_characters", "minimum_characters", "maximum_characters", F.size("page_coverage").alias("n_pages"))


PROFILE_SQL = f"""WITH {WINDOWS_SQL}, c AS (SELECT doc_id, n, any_value(length(text)) AS chars, any_value(pdf_page) AS pdf_page FROM sources GROUP BY ALL)
SELECT 'fixed' AS strategy, count(*) AS chunk_count, round(avg(chars), 2) AS average_characters, min(chars)::INT AS minimum_characters, max(chars)::INT AS maximum_characters, count(DISTINCT pdf_page)::INT AS n_pages FROM c"""


def _gold_inputs(spark: SparkSession, sf_dir: str, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions from benchmark; each answer rests on the documents with its item's id and a fixed distance further;
    a document's evidence is its second to fifth line among the line blocks."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    qs = items.select(F.concat(F.lit("q"), "item_id").alias("id"), F.lit("?").alias("question"))
    answers = items.select(F.concat(F.lit("q"), "item_id").alias("question_id"), F.array(F.concat(F.lit("D"), "item_id"), F.concat(F.lit("D"), F.col("item_id") + 50)).alias("evidence_ids"))
    held = blocks.where("cast(substring(block_id, -5) as int) between 2 and 5")
    evidence = held.groupBy(F.col("document_id").alias("evidence_id")).agg(F.array_sort(F.collect_list("block_id")).alias("source_block_ids"))
    return qs, answers, evidence


def gold_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate chunks of every question."""
    blocks = durable(line_blocks(spark, sf_dir))  # for the evidence and for the chunks
    mapped = go.gold_mapping(*_gold_inputs(spark, sf_dir, blocks), ch.fixed_windows(blocks), strategies=["fixed"])
    each = mapped.select("question_id", F.explode("relevant_chunk_candidates").alias("c"))
    return each.select("question_id", "c.chunk_id", F.array_join("c.evidence_ids", "|").alias("evidence_ids"), F.size("c.matched_source_block_ids").alias("n_matched"), F.round(F.array_max(F.map_values("c.evidence_coverage")), 4).alias("best"), F.col("c.proposed_relevance").alias("relevance"))


def _gold_sql() -> str:
    return f"""WITH {WINDOWS_SQL},
gold AS (SELECT doc_id, line_index, count(*) OVER (PARTITION BY doc_id) AS n_gold FROM typed WHERE line_index BETWEEN 2 AND 5),
wanted AS (SELECT item_id, unnest([item_id, item_id + 50]) AS doc_id FROM benchmark),
met AS (SELECT w.item_id, s.document_id, s.n, count(*) AS matched, n_gold FROM wanted w JOIN gold g USING (doc_id) JOIN sources s ON s.doc_id = g.doc_id AND s.line_index = g.line_index GROUP BY ALL)
SELECT 'q' || item_id AS question_id, format('{{}}_FIXED_V01_C{{:04d}}', document_id, n) AS chunk_id, document_id AS evidence_ids, matched::INT AS n_matched, round(matched::DOUBLE / n_gold, 4) AS best, (CASE WHEN matched::DOUBLE / n_gold >= 0.5 THEN 2 ELSE 1 END)::INT AS relevance FROM met"""


def fragment_gold_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by fragments that cover at least 0.6 of their block; counts per question."""
    blocks = durable(line_blocks(spark, sf_dir))  # for the evidence and for the chunks
    chunks = durable(ch.fixed_token_windows(blocks, tokens=ch.Tokens(r"\S+")).select("profile", "chunk_id", "source_fragments"))  # for the profiles and the mapping
    mapped = go.gold_mapping(*_gold_inputs(spark, sf_dir, blocks), chunks, "profile", 0.6)
    each = mapped.select("question_id", F.explode("relevant_chunk_candidates").alias("c"))
    return each.select("question_id", "c.chunk_id", F.size("c.matched_source_block_ids").alias("n_matched"), F.size("c.source_fragment_coverage").alias("n_fragments"), F.col("c.proposed_relevance").alias("relevance"))


FRAGMENT_GOLD_SQL = f"""WITH frag AS ({TOKENS_SQL}), keyed AS (SELECT *, split_part(block_id, '_B', 1) AS document_id, split_part(block_id, '_B', 2)::INT AS line_index FROM frag),
{LINES_SQL},
gold AS (SELECT document_id, line_index, count(*) OVER (PARTITION BY document_id) AS n_gold FROM typed WHERE line_index BETWEEN 2 AND 5),
wanted AS (SELECT item_id, 'D' || unnest([item_id, item_id + 50]) AS document_id FROM benchmark),
met AS (SELECT item_id, chunk_id, count(*) FILTER (coverage >= 0.6) AS matched, count(*) AS n, any_value(n_gold) AS n_gold FROM wanted JOIN gold USING (document_id) JOIN keyed USING (document_id, line_index) GROUP BY ALL)
SELECT 'q' || item_id AS question_id, chunk_id, matched::INT AS n_matched, n::INT AS n_fragments, (CASE WHEN matched::DOUBLE / n_gold >= 0.5 THEN 2 ELSE 1 END)::INT AS relevance FROM met WHERE matched > 0"""


def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their evidence in order, and their labels' grades."""
    _, answers, evidence = _gold_inputs(spark, sf_dir, line_blocks(spark, sf_dir))
    evidence = durable(evidence)  # met three times
    full = evidence.select("evidence_id", F.lit("doc").alias("document_id"), F.array(F.lit(1)).alias("pdf_pages"), F.array(F.lit(1)).alias("printed_pages"), F.array(F.lit("start")).alias("title_path"), "source_block_ids", F.lit("t").alias("text"), F.lit("reviewed").alias("review_status"))
    ids = answers.select("question_id", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(evidence.select("evidence_id"), "evidence_id", "left_semi")
    sound = ids.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "evidence_id"))).alias("r")).select("question_id", F.transform("r", lambda x: x["evidence_id"]).alias("evidence_ids"))
    cited, labels = go.cited_answers(sound, full), go.retrieval_labels(sound, full)
    grades = labels.select("question_id", F.aggregate("relevant_evidence", F.lit(0), lambda a, x: a + x["relevance"]).alias("grades"))
    return cited.join(grades, "question_id").select("question_id", F.array_join(F.transform("evidence", lambda e: e["evidence_id"]), "|").alias("evidence_ids"), F.size(F.flatten(F.transform("evidence", lambda e: e["source_block_ids"]))).alias("n_blocks"), "grades")


CITED_SQL = f"""WITH {LINES_SQL}, ev AS (SELECT doc_id, count(*) AS n FROM typed WHERE line_index BETWEEN 2 AND 5 GROUP BY doc_id),
wanted AS (SELECT item_id, unnest([item_id, item_id + 50]) AS doc_id FROM benchmark)
SELECT 'q' || item_id AS question_id, string_agg('D' || doc_id, '|' ORDER BY doc_id) AS evidence_ids, sum(n)::INT AS n_blocks, (2 * count(*))::INT AS grades FROM wanted JOIN ev USING (doc_id) GROUP BY item_id"""


def data_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items by priority and reasons."""
    lines = durable(line_blocks(spark, sf_dir))  # for the queue, the evidence and the chunks
    blocks = lines.withColumn("title_path", F.array(F.concat(F.lit("第"), (F.col("pdf_page") % 3).cast("string"), F.lit("章"))))
    _, _, evidence = _gold_inputs(spark, sf_dir, lines)
    chunks = ch.structural_token_chunks(lines, tokens=ch.Tokens(r"\S+"))
    chapters = spark.createDataFrame([(1, 40, 1), (41, 80, 2)], "start_page int, end_page int, chapter int")
    return rv.data_review_queue(blocks, evidence, chunks, chapters).groupBy("priority", "reasons").agg(F.count("*").alias("n_items"), F.min("block_id").alias("first_block"))


FLAGS = """(score < 0.85 OR regexp_matches(text, '(?:GOO|执加|进考虑|平选择关|中轨迹|建刀具|第章|第③章)') OR opens OR region = 'table_candidate' OR (type = 'header_footer' AND contains(text, '第章')))"""

REVIEW_SQL = f"""WITH RECURSIVE {TOKEN_CHUNKS},
short AS (SELECT DISTINCT document_id, unnest(lines) AS line_index FROM chunks WHERE token_count < 64),
b AS (SELECT *, format('{{}}_B{{:05d}}', document_id, line_index) AS block_id, CASE WHEN pdf_page <= 40 THEN 1 WHEN pdf_page <= 80 THEN 2 END AS chapter, coalesce({FLAGS}, false) AS i FROM regions),
r AS (SELECT block_id, chapter IS NOT NULL AND pdf_page % 3 <> chapter AS a, s.line_index IS NOT NULL AS s, i, b.line_index BETWEEN 2 AND 5 AS e FROM b LEFT JOIN short s ON s.document_id = b.document_id AND s.line_index = b.line_index),
x AS (SELECT block_id, CASE WHEN (a OR s OR i) AND e THEN 'P0' ELSE 'P1' END AS priority,
        array_to_string(list_filter([CASE WHEN a THEN 'suspicious_chapter_path' END, CASE WHEN s THEN 'short_structural_chunk' END, CASE WHEN i THEN 'ocr_or_structure_issue' END, CASE WHEN e THEN 'used_by_reviewed_evidence' END], lambda y: y IS NOT NULL), '|') AS reasons FROM (SELECT block_id, coalesce(a, false) AS a, s, i, e FROM r) WHERE a OR s OR i OR e)
SELECT priority, reasons, count(*) AS n_items, min(block_id) AS first_block FROM x GROUP BY ALL"""


def block_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with issues and how urgent they are."""
    return rv.block_review_queue(line_blocks(spark, sf_dir)).select("priority", "block_id", "block_type", "issues", "review_status")


BLOCK_QUEUE_SQL = f"""WITH {REGIONS_SQL},
f AS (
  SELECT *, list_filter([CASE WHEN score < 0.85 THEN 'low_confidence' END, CASE WHEN regexp_matches(text, '(?:GOO|执加|进考虑|平选择关|中轨迹|建刀具|第章|第③章)') THEN 'possible_ocr_confusion' END,
    CASE WHEN opens THEN 'table_layout_requires_review' WHEN region = 'table_candidate' THEN 'inside_table_candidate' END,
    CASE WHEN type = 'header_footer' AND contains(text, '第章') THEN 'header_chapter_number_missing' END], lambda x: x IS NOT NULL) AS issues FROM regions)
SELECT CASE WHEN list_has_any(issues, ['possible_ocr_confusion', 'table_layout_requires_review']) THEN 1 WHEN list_contains(issues, 'inside_table_candidate') THEN 2 WHEN list_contains(issues, 'low_confidence') THEN 3 ELSE 4 END::INT AS priority,
       format('{{}}_B{{:05d}}', document_id, line_index) AS block_id, type AS block_type, array_to_string(issues, '|') AS issues, 'pending' AS review_status FROM f WHERE len(issues) > 0"""


def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: lines, blocks and flagged blocks of every page."""
    from ..sources.pages import page_paths

    pages = ocr_pages(spark, sf_dir)
    report = bl.page_report(pages, bl.build_blocks(pages, page_paths(spark, {"1-90": ["start"]}), {}, "batch"))
    return report.select("document_id", "pdf_page", "ocr_lines", "blocks", "flagged_blocks")


PAGE_REPORT_SQL = f"""WITH RECURSIVE {REGIONS_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS n, regexp_matches(text, '[。！？；：]$') AS ended, coalesce({FLAGS}, false) AS flagged FROM regions),
fold AS (
  SELECT doc_id, n, 1 AS no, length(text) AS size, type = 'paragraph' AND NOT ended AS open_ FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.doc_id, x.n, CASE WHEN f.open_ AND x.type = 'paragraph' AND f.size + length(x.text) <= 260 THEN f.no ELSE f.no + 1 END,
         CASE WHEN f.open_ AND x.type = 'paragraph' AND f.size + length(x.text) <= 260 THEN f.size + length(x.text) ELSE length(x.text) END, x.type = 'paragraph' AND NOT x.ended
  FROM fold f JOIN numbered x ON x.doc_id = f.doc_id AND x.n = f.n + 1)
SELECT 'D' || d.doc_id AS document_id, (d.doc_id % 100 + 1)::INT AS pdf_page, count(no)::INT AS ocr_lines, CASE WHEN d.doc_id % 100 < 90 THEN count(DISTINCT no) ELSE 0 END AS blocks, CASE WHEN d.doc_id % 100 < 90 THEN count(DISTINCT no) FILTER (flagged) ELSE 0 END AS flagged_blocks
FROM documents d LEFT JOIN (fold JOIN numbered USING (doc_id, n)) x ON x.doc_id = d.doc_id GROUP BY d.doc_id"""


def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested pages that there are none of."""
    return bl.missing_pages(spark.sql("select explode(sequence(-3, 120)) as pdf_page"), ocr_pages(spark, sf_dir))


MISSING_SQL = "SELECT unnest(generate_series(-3, 120))::INT AS pdf_page EXCEPT SELECT (doc_id % 100 + 1)::INT FROM documents"


def blocks_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable blocks by the page ranges that they are in, some in several."""
    from ..sources.pages import page_ranges, ranges_table

    ranges = ranges_table(spark, page_ranges("3, 5-40,30 - 60,99-200"))
    found = ch.in_ranges(ch.usable_blocks(line_blocks(spark, sf_dir)), ranges)
    return found.groupBy("range_index").agg(F.count("*").alias("n_blocks"), F.countDistinct("document_id").alias("n_documents"), F.min("pdf_page").alias("first_page"), F.max("pdf_page").alias("last_page"))


RANGES_SQL = f"""WITH {LINES_SQL}, r(range_index, a, b) AS (VALUES (0, 3, 3), (1, 5, 40), (2, 30, 60), (3, 99, 200))
SELECT range_index, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_documents, min(pdf_page) AS first_page, max(pdf_page) AS last_page FROM typed JOIN r ON pdf_page BETWEEN a AND b WHERE type <> 'header_footer' GROUP BY range_index"""


def gold_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for review, with the coverage of their evidence as JSON."""
    blocks = durable(line_blocks(spark, sf_dir))  # for the evidence and for the chunks
    questions, answers, evidence = _gold_inputs(spark, sf_dir, blocks)
    chunks = durable(ch.fixed_windows(blocks).select("strategy", "chunk_id", "source_block_ids", "text"))  # for their strategies, the mapping and the texts
    queue = go.gold_review_queue(go.gold_mapping(questions, answers, evidence, chunks), questions, chunks)
    return queue.select("question_id", "chunk_id", "evidence_ids", "evidence_coverage", "proposed_relevance", "review_status", "question", F.md5("chunk_text").alias("chunk_md5"))


def _gold_queue_sql() -> str:
    return f"""WITH {WINDOWS_SQL},
gold AS (SELECT doc_id, line_index, count(*) OVER (PARTITION BY doc_id) AS n_gold FROM typed WHERE line_index BETWEEN 2 AND 5),
wanted AS (SELECT item_id, unnest([item_id, item_id + 50]) AS doc_id FROM benchmark),
met AS (SELECT w.item_id, s.document_id, s.n, any_value(s.text) AS text, count(*)::DOUBLE / any_value(n_gold) AS share FROM wanted w JOIN gold g USING (doc_id) JOIN sources s ON s.doc_id = g.doc_id AND s.line_index = g.line_index GROUP BY ALL)
SELECT 'q' || item_id AS question_id, format('{{}}_FIXED_V01_C{{:04d}}', document_id, n) AS chunk_id, document_id AS evidence_ids, '{{"' || document_id || '":' || round(share, 4) || '}}' AS evidence_coverage,
       (CASE WHEN share >= 0.5 THEN 2 ELSE 1 END)::INT AS proposed_relevance, 'pending' AS review_status, '?' AS question, md5(text) AS chunk_md5 FROM met"""


QUERIES = {
    "line_classify": (line_classify, CLASSIFY_SQL),
    "line_issues": (line_issues, ISSUES_SQL),
    "table_region": (table_region, REGION_SQL),
    "title_path": (title_path, TITLE_SQL),
    "paragraph_merge": (paragraph_merge, MERGE_SQL),
    "ocr_summary": (ocr_summary, SUMMARY_SQL),
    "ocr_batch": (ocr_batch, BATCH_SQL),
    "fixed_windows": (fixed_windows, FIXED_SQL),
    "token_windows": (token_windows, TOKENS_SQL),
    "structural_chunks": (structural_chunks, STRUCTURAL_SQL),
    "structural_token_chunks": (structural_token_chunks, STRUCTURAL_TOKENS_SQL),
    "row_table_region": (row_table_region, REGION_SQL),
    "row_title_path": (row_title_path, TITLE_SQL),
    "row_paragraph_merge": (row_paragraph_merge, MERGE_SQL),
    "row_structural_chunks": (row_structural_chunks, STRUCTURAL_SQL),
    "row_structural_token_chunks": (row_structural_token_chunks, STRUCTURAL_TOKENS_SQL),
    "profile_report": (profile_report, PROFILE_SQL),
    "gold_mapping": (gold_mapping, _gold_sql()),
    "fragment_gold_mapping": (fragment_gold_mapping, FRAGMENT_GOLD_SQL),
    "cited_answers": (cited_answers, CITED_SQL),
    "data_review_queue": (data_review_queue, REVIEW_SQL),
    "block_review_queue": (block_review_queue, BLOCK_QUEUE_SQL),
    "page_report": (page_report, PAGE_REPORT_SQL),
    "missing_pages": (missing_pages, MISSING_SQL),
    "blocks_in_ranges": (blocks_in_ranges, RANGES_SQL),
    "gold_review_queue": (gold_review_queue, _gold_queue_sql()),
}

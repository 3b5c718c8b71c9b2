"""The opN queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..functions.partitioning import spread
from .byte_bpe import encode_documents
from .common import durable, read_table, remove, shared_dir
from .embedding_dedup import near_vectors
from .exact_dedup import exact_dedup
from .html_text import main_text
from .language_id import fit_from as fit_languages
from .language_id import identify
from .packing import pack
from .secrets import scan
from .simhash import simhash_groups
from .spelling import spelling_groups
from .suffix_dedup import cut_repeats
from .toxicity import fit_from, score
from .warc import page_records, read_warc, write_warc
from .whitening import whiten


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spread(read_table(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(spread(read_table(spark, sf_dir, "documents")), with_text=False)


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, p, substring(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS p FROM d)),
late AS (SELECT doc_id, p FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
steps AS (SELECT doc_id, p, p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 100 AS starts FROM late),
numbered AS (SELECT doc_id, p, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM steps),
spans AS (SELECT doc_id, span, min(p) AS lo, max(p) + 100 AS hi FROM numbered GROUP BY doc_id, span),
pieces AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM spans),
gone AS (
  SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substring(any_value(h), 2 * max(hi) + 1) AS kept
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: All pairs; hashing has found every link on the test tables.
OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
lows AS (SELECT x, min(y) AS low FROM reached GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN lows ON lows.x = vec_id LEFT JOIN counts ON counts.x = vec_id
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(spread(read_table(spark, sf_dir, "documents")), path, public_tokenizers.PATTERN, with_ids=False)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(read_table(spark, sf_dir, "documents")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(spread(read_table(spark, sf_dir, "documents")), path, public_tokenizers.PATTERN, with_ids=False)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(read_table(spark, sf_dir, "pages"), path)
    responses = read_warc(spark, path, where=(("warc_type", "=", "response"),))
    revisits = read_warc(spark, path, payload=False, where=(("warc_type", "=", "revisit"),))
    found = durable(page_records(responses).unionByName(page_records(revisits)))
    remove(spark, path)
    return found


OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM w
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(spread(docs), fit_from(docs, read_table(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(spread(docs), fit_languages(docs))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spread(read_table(spark, sf_dir, "documents")))


#: crc32 by its table of 256 remainders; near words by what is left of them without one letter.
OP13_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), b::BIGINT)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT w, times, hex(encode(doc_id || ':' || w)) AS x FROM low),
hashed AS (
  SELECT w, times, xor(list_reduce(range(0, length(x) // 2), lambda c, k: xor(c >> 8, t[xor(c & 255, ('0x' || substring(x, 2 * k + 1, 2))::BIGINT) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM coded, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substring(w, 1, (h % length(w))::INT) || substring(w, (h % length(w))::INT + 2) ELSE w END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
less AS (SELECT word, p, substring(word, 1, p) || substring(word, p + 2) AS rest FROM (SELECT word, unnest(range(0, length(word)))::INT AS p FROM words)),
pairs AS (
  SELECT a.word AS x, b.word AS y FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word),
best AS (SELECT x AS word, count(*) AS n_near, arg_min(y, (-n, y)) AS y, max(n) AS most FROM pairs JOIN words ON words.word = y GROUP BY x),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN y END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS last, 0 AS k FROM formed UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN formed f ON f.word = s.last WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, k) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_simhash_dedup": op2_simhash_dedup,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_html_extraction": op4_html_extraction,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_secret_scan": op7_secret_scan,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_warc": op9_warc,
        "op10_toxicity": op10_toxicity,
        "op11_whitening": op11_whitening,
        "op12_language_id": op12_language_id,
        "op13_spelling_groups": op13_spelling_groups,
    }


def oracle_sql() -> dict:
    return {"op1_exact_dedup": OP1_SQL, "op3_suffix_dedup": OP3_SQL, "op5_embedding_dedup": OP5_SQL, "op9_warc": OP9_SQL, "op13_spelling_groups": OP13_SQL}

"""Ranking documents for queries (R1-R4, T1-T3, A7, J11) and combining rankings.

Scores are rounded before they are ranked, so that the order in which a shuffle adds doubles up cannot turn exact ties;
BM25 can rank by unrounded scores too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import vectors as vx
from ..sources.files import durable

QUERY_BLOCK = 64 << 20  # bytes of queries that a task holds at once
SCORE_BLOCK = 64 << 20  # bytes of scores that it holds for a batch of documents
BATCH_ROWS = 1000
TOKENS = 1 << 18  # that are looked up in a vocabulary at once, unless one document has more
PRODUCTS = 1 << 18  # of postings and queries' weights that are multiplied at once
LETTER_BYTES = 1024  # for a query's row over the characters of all, at first guess


def top_k(scored: DataFrame, query_id: str, doc_id: str, k: int, score: str = "score") -> DataFrame:
    """Adds rank; best score first, then the smallest id as text. Spark cuts to k within each task before it
    shuffles (WindowGroupLimit)."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy(query_id).orderBy(F.desc(score), F.col(doc_id).cast("string"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, length); the length is the document's number of tokens."""
    tokens = docs.select(F.col(id_col), tx.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    terms = tokens.select(id_col, F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return terms.groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "query_id", query_text: str = "query", k: int = 10, k1: float = 1.5, b: float = 0.75, keep_zero: bool = True, digits: int | None = 8) -> DataFrame:
    """(query_id, doc_id, score, rank).

    Common terms match nearly every document with nearly every query, so joining postings on terms would make a row for
    each of those. Instead the queries' weights are held as a sparse matrix by term, bounded by QUERY_BLOCK, and a
    batch's scores are added up there, SCORE_BLOCK of them at a time; k rows per query and batch shuffle. Document
    frequencies of the query terms and the mean length come from a pass before, which reduces to a row per term within
    tasks. QUERY_BLOCK holds some 100,000 queries; more of them take further rounds of two passes.

    Scores are rounded to `digits` places before they are ranked, or ranked as they are without. Queries that fewer than
    k documents match are filled up by documents of score zero, in id order, for which k documents are looked at;
    keep_zero=False leaves those out.
    """
    return _bm25(docs, queries, doc_id, doc_text, query_id, query_text, k, [(k1, b)], keep_zero, digits)[0]


def bm25_each(docs: DataFrame, queries: DataFrame, settings: dict[str, tuple[float, float]], doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "query_id", query_text: str = "query", k: int = 10, keep_zero: bool = True, digits: int | None = 8) -> dict[str, DataFrame]:
    """`bm25` for several (k1, b) by name: documents are tokenized as often as for one, as a batch is scored by all."""
    ranked = _bm25(docs, queries, doc_id, doc_text, query_id, query_text, k, list(settings.values()), keep_zero, digits)
    return dict(zip(settings, ranked))


def _bm25(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str, k: int, settings: list[tuple[float, float]], keep_zero: bool, digits: int | None) -> list[DataFrame]:
    words = lambda c: tx.tokens(F.coalesce(F.col(c), F.lit("")))
    asked = queries.select(F.col(query_id).alias("q"), words(query_text).alias("v"))
    base = docs.select(F.col(doc_id).alias("d"), words(doc_text).alias("v"))
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 32), F.lit(0))).first()[0]

    def prepare(held: pa.Table) -> dict:
        vocabulary = pc.unique(pc.list_flatten(held["v"].combine_chunks())).sort()
        counts = base.select("v").mapInArrow(_frequencies(vocabulary), "term long, df long, docs long, length long")
        rows = counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "docs", "length")]).toArrow()  # a row per query term
        term, found, docs_, lengths = (rows[c].to_numpy().astype(np.int64) for c in ("term", "df", "docs", "length"))
        df = np.zeros(len(vocabulary))
        df[term[term >= 0]] = found[term >= 0]
        total, length = int(docs_.sum()), int(lengths.sum())
        return {"vocabulary": vocabulary, "idf": np.log(1 + (total - df + 0.5) / (df + 0.5)), "mean": length / total if length else 1.0}

    def scorer(context: dict):
        def features(batch: pa.RecordBatch) -> tuple:
            doc, terms, tf, lengths = _postings(batch.column("v"), context["vocabulary"])
            return batch.num_rows, doc, terms, [tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / context["mean"])) for k1, b in settings]

        def for_queries(held: pa.Table):
            term, query, weight = _query_weights(held["v"].combine_chunks(), context)
            starts = np.searchsorted(term, np.arange(len(context["idf"]) + 1))

            def score(some: tuple) -> np.ndarray:
                n, doc, terms, gains = some
                total = np.concatenate([weighted_sums(starts, query, weight, terms, doc, gain, held.num_rows, n) for gain in gains])
                return total.astype(np.float64) if digits is None else np.rint(total * 10**digits).astype(np.int64)

            return score

        return features, for_queries

    if k <= 0:
        raise ValueError("k must be positive")
    every = _in_blocks(base, asked, size, scorer, k, as_text=True, prepare=prepare, whole=digits is not None, copies=len(settings)).where("score > 0")
    if len(settings) > 1:
        every = durable(every)  # k rows per query and batch, read once for each of the settings
    out = []
    for copy in range(len(settings)):
        found = every.where(F.col("copy") == copy) if len(settings) > 1 else every
        scored = found.select(F.col("q").alias(query_id), F.col("d").alias(doc_id), (F.col("score") / 10 ** (digits or 0)).alias("score"))
        if keep_zero:
            first = docs.select(doc_id).orderBy(F.col(doc_id).cast("string")).limit(k)
            # Among any k documents and the matches are the k best, so k documents stand in for all that score zero.
            zeros = queries.select(query_id).crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
            scored = scored.unionByName(zeros).groupBy(query_id, doc_id).agg(F.max("score").alias("score"))
        out.append(top_k(scored, query_id, doc_id, k))
    return out


def weighted_sums(starts: np.ndarray, query: np.ndarray, weight: np.ndarray, terms: np.ndarray, doc: np.ndarray, gain: np.ndarray, queries: int, docs: int) -> np.ndarray:
    """Of postings (term, document, gain): the sums of gain times weight, queries x documents.

    A term t has the queries and weights at [starts[t], starts[t + 1]). Sums are added up in the order of the postings,
    PRODUCTS products at a time, so memory does not grow with the queries of a term.
    """
    total = np.zeros(queries * docs)
    each = starts[terms + 1] - starts[terms]
    upto = np.cumsum(each)
    begin = 0
    while begin < len(terms):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - each[begin] + PRODUCTS, "right")))
        n = each[begin:end]
        at = np.repeat(starts[terms[begin:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(total, query[at] * docs + np.repeat(doc[begin:end], n), weight[at] * np.repeat(gain[begin:end], n))
        begin = end
    return total.reshape(queries, docs)


def _postings(lists: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, ...]:
    """(document, term, frequency) of the vocabulary's terms in a batch of token lists, and the lists' lengths. Documents
    are gone through TOKENS tokens at a time, so that memory beside the postings does not grow with the batch."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, size = np.cumsum(lengths), max(1, len(vocabulary))
    parts = [(np.zeros(0, np.int64),) * 2]
    begin = 0
    while begin < len(lists):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - lengths[begin] + TOKENS, "right")))
        term = pc.fill_null(pc.index_in(lists.slice(begin, end - begin).flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(begin, end), lengths[begin:end])[term >= 0]
        parts.append(np.unique(doc * size + term[term >= 0], return_counts=True))
        begin = end
    key, tf = (np.concatenate(c) for c in zip(*parts))
    return key // size, key % size, tf, lengths


def _frequencies(vocabulary: pa.Array):
    """Per task: a row per term of the vocabulary with its document frequency, and one (term -1) with the sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(len(vocabulary), np.int64), 0, 0
        for b in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            _, term, _, lengths = _postings(b.column("v"), vocabulary)
            df += np.bincount(term, minlength=len(vocabulary))
            docs, length = docs + b.num_rows, length + int(lengths.sum())
        seen = np.flatnonzero(df)
        zero = np.zeros(len(seen), np.int64)
        columns = (np.append(seen, -1), np.append(df[seen], 0), np.append(zero, docs), np.append(zero, length))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["term", "df", "docs", "length"])

    return run


def _query_weights(lists: pa.Array, context: dict) -> tuple[np.ndarray, ...]:
    """(term, query, weight) sorted by term: the query's frequency of a term times its idf."""
    query, term, qtf, _ = _postings(lists, context["vocabulary"])
    by = np.argsort(term, kind="stable")
    return term[by], query[by], qtf[by] * context["idf"][term[by]]


def dense_top_k(docs: DataFrame, queries: DataFrame, doc_id: str = "vec_id", doc_vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", k: int = 10, digits: int = 6) -> DataFrame:
    """Exact top k by cosine, (query_id, doc_id, score, rank).

    Query vectors are held by every task while they fit in QUERY_BLOCK, which their count and width show; more of them
    go in several rounds of a pass each. A task multiplies them with its documents batch by batch and keeps k of each batch, ties being
    settled as in the final ranking, so k rows per query and batch shuffle however many documents tie.
    """
    asked = queries.where(F.size(query_vector) > 0).select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    base = docs.where(F.size(doc_vector) > 0).select(F.col(doc_id).alias("d"), F.col(doc_vector).alias("v"))

    def scorer(_: None):
        def for_queries(held: pa.Table):
            unit = _unit(held["v"])
            return lambda vectors: np.rint(unit @ vectors.T * 10**digits).astype(np.int64)

        return lambda batch: _unit(batch.column("v")), for_queries

    found = _in_blocks(base, asked, n * width * 8, scorer, k, as_text=True).withColumn("score", F.col("score") / 10**digits)
    return top_k(found, "q", "d", k).withColumnsRenamed({"q": query_id, "d": doc_id})


def _unit(vectors) -> np.ndarray:
    rows = np.array(vectors.to_pylist(), np.float64)
    if not len(rows):
        return np.zeros((0, 1))
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def _in_blocks(base: DataFrame, asked: DataFrame, size: int, scorer, k: int, as_text: bool, prepare=None, whole: bool = True, copies: int = 1) -> DataFrame:
    """(q, d, score) with the k best of each batch of base (d, v) for every query of asked (q, v).

    prepare, if given, runs on the driver for each table of queries. scorer makes, in a task and from what prepare gave,
    two functions: one takes a batch to its features, the other a table of queries to a function of features that gives
    scores (queries x documents), whole numbers or doubles. Ties in a batch go by d, as text or as it is. With copies, scores
    have the queries that many times over, each with its k best, and a column says which time it is.
    """
    rounds = max(1, math.ceil(size / QUERY_BLOCK))
    schema = T.StructType([T.StructField("q", asked.schema["q"].dataType), T.StructField("d", base.schema["d"].dataType), T.StructField("score", T.LongType() if whole else T.DoubleType())])
    if copies > 1:
        schema = schema.add("copy", T.LongType())
    together = max(1, SCORE_BLOCK // (BATCH_ROWS * 8 * copies))

    def run_for(held: pa.Table, context):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features, for_queries = scorer(context)
            parts = [(part["q"].combine_chunks(), for_queries(part)) for at in range(0, held.num_rows, together) for part in (held.slice(at, together),)]
            for b in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
                n = b.num_rows
                if not n or not parts:
                    continue
                order = np.empty(n, np.int64)
                order[pc.sort_indices(b.column("d").cast(pa.string()) if as_text else b.column("d")).to_numpy()] = np.arange(n)
                some = features(b)
                for ids, score_of in parts:
                    score = score_of(some)
                    if whole:
                        best = np.argpartition(-(score * n - order), min(k, n) - 1, axis=1)[:, : min(k, n)]
                    else:
                        best = np.lexsort((np.broadcast_to(order, score.shape), -score), axis=1)[:, :k]
                    q = np.repeat(np.arange(len(score)), best.shape[1])
                    d = best.ravel()
                    columns = [ids.take(pa.array(q % len(ids))), b.column("d").take(pa.array(d)), pa.array(score[q, d]), pa.array(q // len(ids))]
                    yield pa.RecordBatch.from_arrays(columns[: len(schema)], schema.names)

        return run

    found = None
    for r in range(rounds):
        held = asked.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == r).toArrow()  # QUERY_BLOCK or so
        part = base.mapInArrow(run_for(held, prepare(held) if prepare else None), schema)
        found = part if found is None else found.unionByName(part)
    return found


def normalized_vectors(docs: DataFrame, vector: str = "embedding") -> DataFrame:
    """Docs with unit vectors, to be written as the vector index."""
    return docs.withColumn(vector, vx.l2_normalize(F.col(vector)))


def character_overlap_top_k(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "query_id", query_text: str = "query", k: int = 10) -> DataFrame:
    """By the number of distinct characters that a query and a document share; ties by id order. Documents that
    share none do not appear.

    Every document shares characters with nearly every query, so joining on characters would give a row for each of
    them. Instead the queries' character sets are held as for dense ranking, and a batch's overlaps are one matrix
    product over the characters that queries have.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.coalesce(F.col(query_text), F.lit("")).alias("v"))
    size = asked.agg(F.coalesce(F.sum(F.length("v") + LETTER_BYTES), F.lit(0))).first()[0]
    base = docs.select(F.col(doc_id).alias("d"), F.coalesce(F.col(doc_text), F.lit("")).alias("v"))

    def scorer(letters: dict[str, int]):
        def rows(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
            has = np.zeros((len(texts), len(letters) + 1), np.float32)
            for row, text in enumerate(texts.to_pylist()):
                has[row, [letters[c] for c in set(text) if c in letters]] = 1
            return has

        def for_queries(held: pa.Table):
            wanted = rows(held["v"])
            return lambda has: (wanted @ has.T).astype(np.int64)

        return lambda batch: rows(batch.column("v")), for_queries

    def letters(held: pa.Table) -> dict[str, int]:
        return {c: n for n, c in enumerate(sorted(set().union(*map(set, held["v"].to_pylist()))))}

    found = _in_blocks(base, asked, size, scorer, k, as_text=False, prepare=letters).where("score > 0")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("d").alias(doc_id), F.col("score").cast("int").alias("score"), "rank")


def graded_judgments(labels: DataFrame) -> DataFrame:
    """(question_id, relevant_ids, relevance) from evidence labels or from chunk candidates, as the schema says."""
    if "relevant_evidence" in labels.columns:
        pairs = F.transform("relevant_evidence", lambda e: F.struct(e["evidence_id"].alias("id"), e["relevance"].cast("double").alias("grade")))
    else:
        pairs = F.transform("relevant_chunk_candidates", lambda e: F.struct(e["chunk_id"].alias("id"), e["proposed_relevance"].cast("double").alias("grade")))
    ids = F.transform("pairs", lambda p: p["id"])
    last = F.transform(F.array_distinct(ids), lambda i: F.element_at(F.filter("pairs", lambda p: p["id"] == i), -1))
    return labels.withColumn("pairs", pairs).select("question_id", ids.alias("relevant_ids"), F.map_from_entries(last).alias("relevance"))


def as_runs(ranked: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """(question_id, retrieved_ids, scores) per query, best first; k entries each."""
    rows = ranked.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(doc_id).cast("string").alias("id"), "score"))).alias("r"))
    return rows.select(F.col(query_id).cast("string").alias("question_id"), F.transform("r", lambda x: x["id"]).alias("retrieved_ids"), F.transform("r", lambda x: x["score"].cast("double")).alias("scores"))


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, query_id: str, doc_id: str, k: int = 10, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over two rankings. Specified only; the constant is a choice."""
    both = first.select(query_id, doc_id, "rank").unionByName(second.select(query_id, doc_id, "rank"))
    scored = both.groupBy(query_id, doc_id).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score"))
    return top_k(scored, query_id, doc_id, k)


def weighted_fusion(first: DataFrame, second: DataFrame, query_id: str, doc_id: str, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """Alpha times the first's and 1 - alpha times the second's scores, each scaled to 0-1 per query. Specified only."""

    def scaled(ranked: DataFrame, weight: float) -> DataFrame:
        w = Window.partitionBy(query_id)
        low, high = F.min("score").over(w), F.max("score").over(w)
        share = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
        return ranked.select(query_id, doc_id, (weight * share).alias("part"))

    both = scaled(first, alpha).unionByName(scaled(second, 1 - alpha))
    scored = both.groupBy(query_id, doc_id).agg(F.round(F.sum("part"), 8).alias("score"))
    return top_k(scored, query_id, doc_id, k)


def metadata_filter(docs: DataFrame, **equal: object) -> DataFrame:
    """Hard metadata filter before ranking; plain equality, so Parquet scans get it pushed down. Specified only."""
    for name, value in equal.items():
        docs = docs.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return docs


def normalize_spoken(queries: DataFrame, lexicon: DataFrame, text_col: str = "query") -> DataFrame:
    """Replace spoken or variant expressions by their standard ones, longest first. Specified only.

    lexicon (variant, standard) is a curated table; it becomes one array, sorted longest first, that a fold walks.
    """
    entries = lexicon.where("variant <> ''").agg(F.array_sort(F.collect_list(F.struct((-F.length("variant")).alias("n"), "variant", "standard"))).alias("entries"))
    # One row; a lexicon is some hundred entries.
    with_entries = queries.crossJoin(F.broadcast(entries))
    folded = F.aggregate("entries", F.col(text_col), lambda acc, e: F.replace(acc, e["variant"], e["standard"]))
    return with_entries.withColumn("normalized_query", folded).drop("entries")


def lexicon_entries(table: DataFrame, standard: str, variants: str, separators: str = "[,;/、]") -> DataFrame:
    """(variant, standard) rows of a lexicon file whose variants are one separated cell."""
    each = F.explode(F.split(F.coalesce(F.col(variants), F.lit("")), separators)).alias("variant")
    return table.select(F.col(standard).alias("standard"), each).withColumn("variant", tx.strip(F.col("variant"))).where("variant <> ''").dropDuplicates(["variant"])


def select_text(docs: DataFrame, field: str, fallback: Column | None = None) -> DataFrame:
    """docs with `text` taken from a field, or from the fallback where that is null or empty."""
    chosen = F.col(field) if fallback is None else tx.first_filled(F.col(field), fallback)
    return docs.withColumn("text", chosen)

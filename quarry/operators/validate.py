"""Validators (V1-V4) and the checks they are made of.

A check is a table (check, id) of what is wrong; a validator is their union. Checks of an entity's rows come from one
scan of it (`failing_all`), and those of one key's presence in several entities from one grouping of all of them
(`reconciled`). `summary` turns problems into one row per check, of a bounded size; `write_problems` keeps the ids
themselves as a sorted table; `report` puts them into the row, for few problems; `status` is pass or fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.files import durable
from .blocks import with_lines
from .chunks import Tokens


def _as(df: DataFrame, name: str, id_: Column | str) -> DataFrame:
    return df.select(F.lit(name).alias("check"), (F.col(id_) if isinstance(id_, str) else id_).cast("string").alias("id"))


def duplicates(df: DataFrame, key: str, name: str) -> DataFrame:
    """A1: keys that occur more than once."""
    return _as(df.groupBy(key).count().where("count > 1"), name, key)


def unmatched(left: DataFrame, left_key: str, right: DataFrame, right_key: str, name: str) -> DataFrame:
    """Distinct keys of the left that the right lacks."""
    keys = left.select(F.col(left_key).alias("k")).where("k is not null").distinct()
    return _as(keys.join(right.select(F.col(right_key).alias("k")), "k", "left_anti"), name, "k")


def failing(df: DataFrame, key: str | Column, test: Column, name: str) -> DataFrame:
    """Rows for which the test holds."""
    return _as(df.where(test), name, key)


def failing_all(df: DataFrame, key: str | Column, tests: dict[str, Column]) -> DataFrame:
    """As failing for several tests by name, in one scan: a row and its id come once for each test that holds."""
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    id_ = F.col(key) if isinstance(key, str) else key
    return df.select(id_.cast("string").alias("id"), F.explode(names).alias("check")).select("check", "id")


def reconciled(sides: dict[str, tuple[DataFrame, str]], repeated: dict[str, str], lacking: dict[tuple[str, str], str]) -> DataFrame:
    """A1 and J8 over one kind of id: keys that occur more than once in a side, and keys of a side that another lacks.

    sides: tables and their key by a name; repeated: the check's name by side; lacking: by (side, other). Every key is
    counted per side within tasks and shuffles once, where checks by themselves would group or join it anew.
    """
    names = list(sides)
    count = {n: f"n{k}" for k, n in enumerate(names)}
    tagged = None
    for name, (df, key) in sides.items():
        one = df.select(F.col(key).cast("string").alias("id"), *[F.lit(int(n == name)).cast("long").alias(count[n]) for n in names])
        tagged = one if tagged is None else tagged.unionByName(one)
    counts = tagged.groupBy("id").agg(*[F.sum(count[n]).alias(count[n]) for n in names])
    tests = {check: F.col(count[n]) > 1 for n, check in repeated.items()}
    tests |= {check: F.col("id").isNotNull() & (F.col(count[a]) > 0) & (F.col(count[b]) == 0) for (a, b), check in lacking.items()}
    return failing_all(counts, "id", tests)


def set_disagreements(left: DataFrame, right: DataFrame, key: str, left_set: str, right_set: str, name: str) -> DataFrame:
    """Keys of both sides whose id sets differ."""
    members = lambda c: F.array_sort(F.array_distinct(c))
    both = left.select(key, members(left_set).alias("a")).join(right.select(key, members(right_set).alias("b")), key)
    return _as(both.where(F.col("a") != F.col("b")), name, key)


def value_counts(df: DataFrame, values: Column) -> DataFrame:
    """A2: (value, n) over an array column's entries or a plain column's."""
    return df.select(values.alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def union(checks: list[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def summary(problems: DataFrame, names: list[str]) -> DataFrame:
    """K2: (check, n, n_ids, first_id) for every check, also for those that found nothing; rows stay small however many
    ids there are."""
    rows = problems.sparkSession.createDataFrame([(n,) for n in names], "check string")
    found = problems.groupBy("check").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id"))
    return rows.join(found, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_ids", F.lit(0)).alias("n_ids"), "first_id")


def write_problems(problems: DataFrame, names: list[str], path: str) -> DataFrame:
    """K2: writes the problems as a table by check, sorted by id over files, and returns the summary with each check's
    folder. The checks run once; the summary is made of what was written."""
    problems.repartitionByRange("check", "id").sortWithinPartitions("check", "id").write.mode("overwrite").partitionBy("check").parquet(path)
    written = problems.sparkSession.read.schema("id string, check string").parquet(path)
    return summary(written, names).withColumn("folder", F.when(F.col("n") > 0, F.concat(F.lit(f"{path}/check="), "check")))


def report(problems: DataFrame, names: list[str]) -> DataFrame:
    """K2: one row per check, also for those that found nothing, with all ids in it: for problems that fit in a row."""
    rows = problems.sparkSession.createDataFrame([(n,) for n in names], "check string")
    found = problems.groupBy("check").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("id")).alias("ids"))
    return rows.join(found, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def status(checks: DataFrame) -> DataFrame:
    """Fail if any check found something."""
    return checks.agg(F.when(F.coalesce(F.max(F.col("n") > 0), F.lit(False)), "fail").otherwise("pass").alias("status"))


def ocr_blocks(pages: DataFrame, blocks: DataFrame, expected: DataFrame, page_offset: int = -8) -> DataFrame:
    """V1. expected (pdf_page, token): strings that sample pages must hold."""
    first = F.col("results")[0]
    lengths = F.array_distinct(F.array(F.size(first["rec_texts"]), F.size(first["rec_scores"]), F.size(first["rec_boxes"])))
    # The expected strings go to the pages; pages, which are whole texts, do not shuffle.
    sample = pages.join(expected, "pdf_page")
    nowhere = expected.join(pages.select("pdf_page").distinct(), "pdf_page", "left_anti")
    text = F.array_join(first["rec_texts"], "\n")
    tests = {
        "invalid_printed_page_mappings": F.col("printed_page") != F.col("pdf_page") + page_offset,
        "empty_text_blocks": tx.is_blank(F.col("text")),
        "invalid_review_status": F.col("review_status") != "auto_draft",
    }
    # What the checks ask of a block, without its text; made once, since blocks cost much more than these.
    blocks = durable(blocks.select("block_id", "pdf_page", "source_line_ids", *[test.alias(name) for name, test in tests.items()]))
    ours = blocks.select("pdf_page").distinct()
    sound = pages.where(F.size(lengths) == 1).join(ours, "pdf_page", "left_semi")
    # Outer, since an inner one makes Spark infer a filter that computes the lines a second time; pages without lines go behind it.
    line_ids = with_lines(sound).select(F.explode_outer("lines.source_line_id").alias("line_id")).where("line_id is not null")
    held = blocks.select(F.explode("source_line_ids").alias("line_id"))
    return union(
        [
            failing(pages.join(expected.select("pdf_page"), "pdf_page", "left_semi"), "pdf_page", F.size(lengths) > 1, "array_lengths_differ"),
            failing(sample, F.concat_ws(":", "pdf_page", "token"), ~F.coalesce(text.contains(F.col("token")), F.lit(False)), "missing_expected_tokens"),
            _as(nowhere, "missing_expected_tokens", F.concat_ws(":", "pdf_page", "token")),
            duplicates(blocks, "block_id", "duplicate_block_ids"),
            reconciled(
                {"lines": (line_ids, "line_id"), "held": (held, "line_id")},
                {"held": "duplicate_source_line_ids"},
                {("lines", "held"): "missing_source_line_ids", ("held", "lines"): "unexpected_source_line_ids"},
            ),
            failing_all(blocks, "block_id", {name: F.col(name) for name in tests}),
        ]
    )


def _citation_differs() -> Column:
    c = F.col("citation")
    return ~(c["quote"].eqNullSafe(F.col("text")) & c["source_block_ids"].eqNullSafe(F.col("source_block_ids")) & c["pdf_pages"].eqNullSafe(F.col("pdf_pages")))


def chunk_artifacts(chunks: DataFrame, blocks: DataFrame, mappings: DataFrame, evidence: DataFrame, answers: DataFrame) -> DataFrame:
    """V2: chunks of one strategy and their gold mappings."""
    cited = chunks.select(F.explode("source_block_ids").alias("block_id"))
    candidates = mappings.select("question_id", F.explode("relevant_chunk_candidates").alias("c")).select("question_id", "c.chunk_id", "c.evidence_ids", "c.matched_source_block_ids")
    known = candidates.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    # A10: what a question's candidates cover of each evidence, against all that the evidence names.
    matched = known.select("question_id", F.explode("evidence_ids").alias("evidence_id"), "matched_source_block_ids").groupBy("question_id", "evidence_id").agg(F.array_distinct(F.flatten(F.collect_list("matched_source_block_ids"))).alias("m"))
    partial = matched.join(evidence, "evidence_id").where(F.size(F.array_except("source_block_ids", "m")) > 0)
    asked = mappings.select("question_id").join(answers.select("question_id", F.explode("evidence_ids").alias("evidence_id")), "question_id")
    unmapped = asked.join(matched, ["question_id", "evidence_id"], "left_anti")
    return union(
        [
            duplicates(chunks, "chunk_id", "duplicate_chunk_ids"),
            unmatched(cited, "block_id", blocks, "block_id", "missing_source_block_ids"),
            failing_all(chunks, "chunk_id", {"empty_chunks": tx.is_blank(F.col("text")), "invalid_citations": _citation_differs()}),
            unmatched(candidates, "chunk_id", chunks, "chunk_id", "invalid_candidate_chunk_ids"),
            _as(partial, "incomplete_evidence_coverage", F.concat_ws(":", "question_id", "evidence_id")),
            _as(unmapped, "incomplete_evidence_coverage", F.concat_ws(":", "question_id", "evidence_id", F.lit("unmapped"))),
            failing_all(mappings, "question_id", {"questions_without_candidates": F.size("relevant_chunk_candidates") == 0, "non_draft_mappings": F.col("mapping_status") != "draft_pending_human_review"}),
        ]
    )


def chunk_matrix(chunks: DataFrame, blocks: DataFrame, mappings: DataFrame, hashes: DataFrame | None = None, tokens: Tokens | None = None) -> DataFrame:
    """V3: token chunks. hashes (file, sha256, expected) compares files with a manifest; token counts are made anew."""
    each = chunks.select("chunk_id", F.explode("source_fragments").alias("f")).select("chunk_id", "f.*")
    sized = each.join(blocks.select("block_id", F.length(tx.strip(F.col("text"))).alias("size")), "block_id", "left")
    a, b, n = F.col("block_character_start"), F.col("block_character_end"), F.col("block_character_count")
    sound = (n == F.col("size")) & (a >= 0) & (a < b) & (b <= n) & (F.abs((b - a) / F.greatest(n, F.lit(1)) - F.col("coverage")) <= 1e-5)
    problem = F.when(F.col("size").isNull(), "missing").otherwise("invalid")
    checks = [
        duplicates(chunks, "chunk_id", "duplicate_chunk_ids"),
        failing_all(
            chunks,
            "chunk_id",
            {"empty_chunks": tx.is_blank(F.col("text")), "invalid_token_counts": (tokens or Tokens()).count(F.col("text")) != F.col("token_count"), "invalid_citations": _citation_differs()},
        ),
        failing(sized, F.concat_ws(":", "chunk_id", "block_id", problem), ~F.coalesce(sound, F.lit(False)), "invalid_source_fragments"),
        failing(mappings, "question_id", F.size("relevant_chunk_candidates") == 0, "questions_without_candidates"),
    ]
    if hashes is not None:
        checks.append(failing(hashes, "file", ~F.col("sha256").eqNullSafe(F.col("expected")), "hash_mismatches"))
    return union(checks)


def dev_dataset(questions: DataFrame, answers: DataFrame, cited_answers: DataFrame, evidence: DataFrame, labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """V4: questions, answers, evidence, labels and blocks against each other."""
    referenced = answers.select(F.explode("evidence_ids").alias("evidence_id"))
    used_blocks = evidence.select(F.explode("source_block_ids").alias("block_id"))
    label_ids = labels.withColumn("ids", F.transform("relevant_evidence", lambda e: e["evidence_id"]))
    labelled = label_ids.select(F.explode("ids").alias("evidence_id"))
    expanded = F.transform("evidence", lambda e: e["evidence_id"])
    unreviewed = F.exists("evidence", lambda e: e["review_status"] != "reviewed")
    return union(
        [
            reconciled(
                {"questions": (questions, "id"), "answers": (answers, "question_id"), "labels": (labels, "question_id"), "cited": (cited_answers, "question_id")},
                {"questions": "duplicate_question_ids", "answers": "duplicate_answer_question_ids", "labels": "duplicate_retrieval_question_ids", "cited": "duplicate_cited_answer_ids"},
                {
                    ("questions", "answers"): "questions_without_answers",
                    ("answers", "questions"): "answers_without_questions",
                    ("questions", "labels"): "questions_without_retrieval_labels",
                    ("labels", "questions"): "retrieval_labels_without_questions",
                    ("answers", "cited"): "answers_without_cited_view",
                    ("cited", "answers"): "cited_view_without_answers",
                },
            ),
            reconciled(
                {"evidence": (evidence, "evidence_id"), "referenced": (referenced, "evidence_id"), "labelled": (labelled, "evidence_id")},
                {"evidence": "duplicate_evidence_ids"},
                {("referenced", "evidence"): "missing_evidence_ids", ("evidence", "referenced"): "unreferenced_evidence_ids", ("labelled", "evidence"): "missing_retrieval_evidence_ids"},
            ),
            unmatched(used_blocks, "block_id", blocks, "block_id", "missing_source_block_ids"),
            set_disagreements(answers, label_ids, "question_id", "evidence_ids", "ids", "answer_label_disagreements"),
            failing(cited_answers, "question_id", ~F.col("evidence_ids").eqNullSafe(expanded) | unreviewed, "invalid_expanded_citations"),
            failing(answers, "question_id", F.col("annotation_status") != "reviewed", "non_reviewed_answers"),
            failing(evidence, "evidence_id", F.col("review_status") != "reviewed", "non_reviewed_evidence"),
        ]
    )

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunks as ch
from quarry.sources.pages import page_ranges, ranges_table

SCHEMA = (
    "block_id string, document_id string, pdf_page int, printed_page int, block_type string, layout_region string, text string, title_path array<string>, source_line_ids array<string>, issues array<string>"
)


def frame(spark, rows):
    full = [(f"B{k:04d}", "D", r.get("page", 1), r.get("page", 1), r.get("type", "paragraph"), r.get("region"), r["text"], r.get("path", ["p"]), [f"L{k}"], r.get("issues", [])) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def texts(df):
    return [(r.chunk_id, r.text, list(r.source_block_ids)) for r in df.orderBy("chunk_id").collect()]


def test_windows_step_and_stop(spark):
    got = ch.fixed_windows(frame(spark, [{"text": "abcdefghi"}]), size=4, overlap=1)
    assert [t for _, t, _ in texts(got)] == ["abcd", "defg", "ghi"]


def plain_windows(parts, size, overlap):
    whole, spans = "", []
    for k, p in enumerate(parts):
        spans.append((len(whole), len(whole) + len(p) + 1, f"B{k:04d}"))
        whole += p + "\n"
    out, at = [], 0
    while at < len(whole):
        end = min(at + size, len(whole))
        if whole[at:end].strip():
            out.append((whole[at:end].strip(), [b for lo, hi, b in spans if lo < end and hi > at]))
        if end == len(whole):
            break
        at = end - overlap
    return out


@pytest.mark.parametrize("seed", range(3))
def test_windows_against_plain_rule(spark, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab cd") for _ in range(rng.randint(1, 40))).strip() or "x" for _ in range(rng.randint(1, 25))]
    size = rng.randint(5, 30)
    overlap = rng.randint(0, size - 1)
    got = ch.fixed_windows(frame(spark, [{"text": p} for p in parts]), size=size, overlap=overlap)
    assert [(t, s) for _, t, s in texts(got)] == plain_windows(parts, size, overlap)


def test_ranges_split_documents_and_numbering_goes_on(spark):
    df = frame(spark, [{"text": "a", "page": 1}, {"text": "b", "page": 5}, {"text": "c", "page": 9}])
    got = ch.fixed_windows(df, ranges_table(spark, page_ranges("1-5,5,20")), size=10, overlap=2)
    assert [(i, t) for i, t, _ in texts(got)] == [("D_FIXED_V01_C0001", "a\nb"), ("D_FIXED_V01_C0002", "b")]


def test_windows_refuse_bad_sizes(spark):
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            ch.fixed_windows(frame(spark, [{"text": "a"}]), size=size, overlap=overlap)


def test_details_and_citation(spark):
    rows = [{"text": "a", "page": 2, "path": ["x", "y"], "issues": ["i2", "i1"]}, {"text": "b", "page": 1, "path": ["x", "y"], "issues": ["i1"]}, {"text": "h", "type": "header_footer"}, {"text": " "}]
    r = ch.fixed_windows(frame(spark, rows), order=("block_id",), title="T").first()
    assert (r.pdf_pages, r.title_paths, r.issues, r.retrieval_text) == ([1, 2], ["x > y"], ["i1", "i2"], "x > y\na\nb")
    assert (r.citation.quote, r.citation.source_block_ids, r.citation.document_title) == ("a\nb", ["B0000", "B0001"], "T")


def test_token_windows_cover_every_token(spark):
    parts = ["a b c d", "e f", "g h i j k l m"]
    got = ch.fixed_token_windows(frame(spark, [{"text": p} for p in parts]), size=5, overlap=2, tokens=ch.Tokens(r"\S+"))
    assert [t for _, t, _ in texts(got)] == ["a b c d\ne", "d\ne f\ng h", "g h i j k", "j k l m"]
    row = got.orderBy("chunk_id").collect()[1]
    assert [(f.block_id, f.block_character_start, f.block_character_end, f.coverage) for f in row.source_fragments] == [("B0000", 6, 7, 0.142857), ("B0001", 0, 3, 1.0), ("B0002", 0, 3, 0.230769)]
    assert all(r.token_count <= 5 for r in got.collect())


def test_token_windows_go_through_the_blocks_once(spark):
    blocks = frame(spark, [{"text": "a b c d"}, {"text": "e f"}])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(blocks).count("LogicalRDD") == 1
    assert plan(ch.fixed_token_windows(blocks, tokens=ch.Tokens(r"\S+"))).count("LogicalRDD") == 1


def plain_structural(rows, most, least):
    groups, cur = [], []
    for k, r in enumerate(rows):
        if cur:
            p = rows[cur[-1]]
            edge = r["path"] != p["path"] or r["type"] == "heading" or r["region"] != p["region"]
            if edge or sum(len(rows[i]["text"]) + 1 for i in cur) + len(r["text"]) > most:
                groups.append(cur)
                cur = []
        cur = cur + [k]
    if cur:
        groups.append(cur)
    size = lambda g: sum(len(rows[i]["text"]) + 1 for i in g)
    out, k = [], 0
    while k < len(groups):
        g = groups[k]
        if size(g) < least and k + 1 < len(groups):
            groups[k + 1] = g + groups[k + 1]
        elif size(g) < least and out and size(out[-1]) + size(g) <= most:
            out[-1] = out[-1] + g
        else:
            out.append(g)
        k += 1
    return [[f"B{i:04d}" for i in g] for g in out]


@pytest.mark.parametrize("seed", range(4))
def test_structural_chunks_against_plain_rule(spark, seed):
    rng = random.Random(seed)
    rows = [{"text": "x" * rng.randint(1, 60), "path": [f"p{rng.randint(0, 1)}"], "type": rng.choice(["paragraph"] * 4 + ["heading"]), "region": rng.choice([None] * 5 + ["t"])} for _ in range(40)]
    got = ch.structural_chunks(frame(spark, rows), most=120, least=30)
    assert [s for _, _, s in texts(got)] == plain_structural(rows, 120, 30)


def test_structural_token_chunks_merge_backward_within_a_section(spark):
    rows = [{"text": "a b c d e f", "path": ["p"]}, {"text": "g", "path": ["q"]}, {"text": "H", "type": "heading", "path": ["r"]}, {"text": "i j k", "path": ["r"]}, {"text": "l", "path": ["r"], "region": "t"}]
    got = ch.structural_token_chunks(frame(spark, rows), most=8, least=3, tokens=ch.Tokens(r"\S+"))
    # g is small but opens a section of its own; l is small and continues the section of H.
    assert [s for _, _, s in texts(got)] == [["B0000"], ["B0001"], ["B0002", "B0003", "B0004"]]
    assert got.where(F.col("token_count") > 8).count() == 0


def test_profile_report(spark):
    r = ch.profile_report(ch.fixed_windows(frame(spark, [{"text": "abcdefghi", "issues": ["i"]}]), size=4, overlap=1)).first()
    assert (r.chunk_count, r.average_characters, r.minimum_characters, r.maximum_characters, r.chunks_with_issues) == (3, 3.67, 3, 4, 3)


def test_a_tokenizer_file_as_source_of_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    count = lambda t: len([1 for a, b in library.encode(t, add_special_tokens=False).offsets if b > a])
    rng = random.Random(3)
    parts = [" ".join(rng.choices(["window", "刀具补偿", "G01", "unbelievable", "x"], k=rng.randint(1, 12))) for _ in range(12)]
    got = ch.fixed_token_windows(frame(spark, [{"text": p} for p in parts]), size=20, overlap=4, tokens=ch.Tokens(file=path)).orderBy("chunk_id").collect()
    whole = "".join(p + "\n" for p in parts)
    offsets = [(a, b) for a, b in library.encode(whole, add_special_tokens=False).offsets if b > a]
    assert [r.text for r in got] == [whole[a:b].strip() for a, b in ch.token_windows(offsets, 20, 16, lambda a, b: count(whole[a:b]))]
    assert all(r.token_count == count(r.text) <= 20 for r in got)
    chunks = ch.structural_token_chunks(frame(spark, [{"text": p} for p in parts]), most=30, least=5, tokens=ch.Tokens(file=path)).orderBy("chunk_id").collect()
    assert [b for r in chunks for b in r.source_block_ids] == [f"B{k:04d}" for k in range(12)] and all(count(r.text) <= 30 for r in chunks)


def test_title_paths_are_compared_as_lists_and_blocks_come_by_number(spark):
    rows = [(f"D_P001_B{n:03d}", f"text {n}", ["ab", "c"] if n < 1000 else ["a", "bc"]) for n in (1000, 999, 1001, 7)]
    blocks = spark.createDataFrame([(b, "D", 1, 1, "paragraph", None, t, p, [b], []) for b, t, p in rows], "block_id string, document_id string, pdf_page int, printed_page int, block_type string, layout_region string, text string, title_path array<string>, source_line_ids array<string>, issues array<string>")
    found = [r.source_block_ids for r in ch.structural_chunks(blocks, least=1).orderBy("chunk_id").collect()]
    assert found == [["D_P001_B007", "D_P001_B999"], ["D_P001_B1000", "D_P001_B1001"]]
    tokens = [r.source_block_ids for r in ch.structural_token_chunks(blocks, least=1, tokens=ch.Tokens(r"\S+")).orderBy("chunk_id").collect()]
    assert tokens == found
    (window,) = ch.fixed_windows(blocks).collect()
    assert window.source_block_ids == [*found[0], *found[1]]
    null_path = blocks.withColumn("title_path", F.when(F.col("block_id") != "D_P001_B999", F.col("title_path")))
    assert [len(r.source_block_ids) for r in ch.structural_chunks(null_path, least=1).orderBy("chunk_id").collect()] == [1, 1, 2]

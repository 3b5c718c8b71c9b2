"""Scalar text functions as Column expressions. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns and strings that define line kinds, codes and tokens.
SECTION = r"^(\d+(?:\.\d+){1,2})\s*(.+)?$"
SUBHEADING = r"^（[0-9一二三四五六七八九十]+）"
CAPTION = r"^[图表]\s*\d+[-—]\d+"
FIGURE_MENTION = r"^图\s*\d+[-—]\d+所示"
PAGE_HEADER = r"^(?:第.*章.*\d{2,3}|\d{1,3}|FANUC数控编程手册)$"
CODE_TOKEN = r"(?:^|\s)(?:N\d+)?\s*(?:G\d{1,3}|M\d{1,3}|[XYZUWRIJKFPQSDT][-+]?\d)"
SUSPICIOUS = ("GOO", "执加", "进考虑", "平选择关", "中轨迹", "建刀具", "第章", "第③章")
CODE_MENTION = r"(?i)(?<![A-Z])[GMTFSXYZIJKRPQ]\s*[+-]?\d+(?:\.\d+)?"
EXERCISE = "练一练"
LABELS = ("指令格式：", "各地址含义：", "注意：")
SENTENCE_ENDS = ("。", "！", "？", "；", "：")
#: On lowered text; U+0131 and U+017F are what else is a Latin letter to (?iU)[a-z], which takes twice the time.
LATIN_TOKEN = r"[a-z\x{131}\x{17F}]+\p{Nd}*(?:\.\p{Nd}+)?|\p{Nd}+(?:\.\p{Nd}+)?"
HAN = "[一-鿿]"
HEADINGS = ("heading", "subheading", "exercise_heading")

#: What Unicode calls white space, which strip() takes off and \s matches in (?U) mode, and the four separators U+001C-1F.
SPACE = r"[\s\x{1C}-\x{1F}]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; F.trim alone takes off spaces only."""
    return F.trim(c, F.lit(SPACES))


def normalize(c: Column) -> Column:
    """stripped, and each run of white space one space."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def matches(c: Column, pattern: str, flags: str = "U") -> Column:
    return c.rlike(f"(?{flags}){pattern}")


def han_count(c: Column) -> Column:
    """H5: how many CJK unified ideographs."""
    return F.regexp_count(c, F.lit(HAN))


def is_code(c: Column) -> Column:
    """a CNC code token and at most four ideographs."""
    return matches(c, r"\d") & matches(c, CODE_TOKEN, "iU") & (han_count(c) <= 4)  # few lines have a digit, which is quickly seen


def classify(text: Column, line_index: Column) -> Column:
    """the kind of a line; the first rule that holds decides."""
    rules = [
        ((line_index <= 2) & matches(text, PAGE_HEADER), "header_footer"),
        (matches(text, SECTION), "heading"),
        (matches(text, SUBHEADING), "subheading"),
        (matches(text, CAPTION) & ~matches(text, FIGURE_MENTION), "caption"),
        (text == EXERCISE, "exercise_heading"),
        (text.isin(*LABELS), "label"),
        (is_code(text), "code"),
    ]
    (test, name), *rest = rules
    return reduce(lambda w, r: w.when(r[0], r[1]), rest, F.when(test, name)).otherwise("paragraph")


def line_issues(text: Column, kind: Column, score: Column, region: Column, least_score: float = 0.85) -> Column:
    """the issue flags of a line, in rule order."""
    table_caption = (kind == "caption") & text.startswith("表")
    flags = F.array(
        F.when(score < least_score, "low_confidence"),
        F.when(reduce(or_, [text.contains(s) for s in SUSPICIOUS]), "possible_ocr_confusion"),
        F.when(table_caption, "table_layout_requires_review").when(region == "table_candidate", "inside_table_candidate"),
        F.when((kind == "header_footer") & text.contains("第章"), "header_chapter_number_missing"),
    )
    return F.array_compact(flags)


def tokens(c: Column) -> Column:
    """H1-H3: code and number tokens, then per run of ideographs its characters and its bigrams."""
    # Not translate, which makes an object of every character.
    lowered = F.replace(F.replace(F.lower(c), F.lit("０"), F.lit("0")), F.lit("１"), F.lit("1"))
    latin = F.regexp_extract_all(lowered, F.lit(LATIN_TOKEN), F.lit(0))
    runs = F.regexp_extract_all(lowered, F.lit(f"{HAN}+"), F.lit(0))

    def grams(run: Column) -> Column:
        singles = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(F.length(run) > 1, F.concat(singles, pairs)).otherwise(singles)

    return F.concat(latin, F.flatten(F.transform(runs, grams)))


def code_mentions(c: Column) -> Column:
    """H4: the distinct codes mentioned, sorted, with spaces (but no other white space) taken out."""
    found = F.regexp_extract_all(c, F.lit(CODE_MENTION), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit("")))))


def page_label(pages: Column) -> Column:
    """A display label for pages in the order given."""
    distinct = F.array_distinct(pages)
    first, last = F.element_at(distinct, 1).cast("string"), F.element_at(distinct, -1).cast("string")
    n = F.size(distinct)
    return F.when(pages.isNull() | (n <= 0), F.lit("页码未知")).when(n == 1, F.concat(F.lit("第"), first, F.lit("页"))).otherwise(F.concat(F.lit("第"), first, F.lit("—"), last, F.lit("页")))


def first_filled(*columns: Column) -> Column:
    """the first that is neither null nor empty; if there is none, the last as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def padded_id(prefix: Column, letter: str, number: Column, width: int = 3) -> Column:
    """prefix, letter and zero-padded number, like DOC_P007."""
    return F.concat(prefix, F.format_string(f"_{letter}%0{width}d", number))


def character_overlap(query: Column, text: Column) -> Column:
    """The number of distinct characters in common."""
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    return F.size(F.array_intersect(letters(query), letters(text)))


def lookup(mapping: Column, key: Column, default: Column) -> Column:
    """A map's value, or the default."""
    return F.coalesce(F.try_element_at(mapping, key), default)


def token_rows(df: DataFrame, key: list[str], text: str, pattern: str | None = None) -> DataFrame:
    """H9: the key columns with (token, s, e) for each token of a text: its number and its [s, e) in code points.

    Tokens come from a context-free pattern; the default takes ideographs singly, and runs of letters and digits, and
    other signs, by themselves. The text between two tokens is what splitting leaves, so places are running sums over
    rows of one text, in time linear in its length. Tokens without width are left out. `key` names one row of df.
    """
    pattern = pattern or DEFAULT_TOKEN
    found = F.regexp_extract_all(F.col(text), F.lit(f"(?U)({pattern})"), F.lit(1))
    gaps = F.split(F.col(text), f"(?U)(?:{pattern})", -1)
    sizes = F.arrays_zip(F.transform(found, F.length).alias("n"), F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"))
    each = df.select(*key, F.posexplode(sizes).alias("token", "x"))
    upto = Window.partitionBy(*key).orderBy("token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("x.n") + F.col("x.gap")).over(upto).cast("int")
    return each.select(*key, "token", (end - F.col("x.n")).alias("s"), end.alias("e")).where("e > s")


def token_spans(text: Column, asked: Column, pattern: str | None = None) -> Column:
    """For the token numbers asked for, an array that goes up: the struct (s, e) that token_rows gives of each, or null. The
    tokens between one number and the next are added up once, so that time is linear in the text's length; nothing is
    looked for in a text of which no token is asked."""
    pattern = pattern or DEFAULT_TOKEN
    found = F.regexp_extract_all(text, F.lit(f"(?U)({pattern})"), F.lit(1))
    gaps = F.split(text, f"(?U)(?:{pattern})", -1)
    sizes = F.arrays_zip(F.transform(found, F.length).alias("n"), F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"))
    nothing = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, token: Column) -> Column:
        some = F.slice(acc["sizes"], acc["upto"] + 1, token - acc["upto"] + 1)
        end = F.aggregate(some, acc["end"], lambda a, x: a + x["n"] + x["gap"])
        start = end - F.element_at(some, -1)["n"]
        met = F.when(end > start, F.struct(start.alias("s"), end.alias("e")))
        return F.struct(acc["sizes"].alias("sizes"), (token + 1).alias("upto"), end.alias("end"), F.array_append(acc["out"], met).alias("out"))

    start = F.struct(sizes.alias("sizes"), F.lit(0).alias("upto"), F.lit(0).alias("end"), nothing.alias("out"))
    return F.when(F.size(asked) > 0, F.aggregate(asked, start, step, lambda acc: acc["out"])).otherwise(nothing)


def token_count(c: Column, pattern: str | None = None) -> Column:
    """The number of tokens that token_rows gives, without their places."""
    return F.regexp_count(c, F.lit(f"(?U){pattern or DEFAULT_TOKEN}"))


DEFAULT_TOKEN = r"(?:\p{IsHan}|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"

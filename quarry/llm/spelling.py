"""Spelling variants: words that differ from another by one inserted, deleted or replaced letter, and their forms.

A positional q-gram inverted index finds them. An edit touches at most Q of a word's q-grams, so two near words share
all but Q of the longer one's, at places that differ by no more than their lengths do, and those by one at most.

1. Words and counts are built-in functions; only distinct words with their counts go on.
2. The index is dealt to tasks by what that bound leaves whole: of the PIECES pieces of a word, all but one, as a long
   gram at the word's beginning and one at its end. A word is sent under each piece that may hold the edit, for near
   words of its own length and for those one letter shorter or longer, 2 * PIECES rows whatever the vocabulary.
3. Each such block has its own inverted index of the q-grams around the open piece, by place and word length. A word's
   postings there, with the lengths and places allowed, are merged by a heap, and what occurs in as many of them as
   the bound asks for is compared letter by letter. A pair counts in the first block that can hold it, so no pair is
   met twice; a block returns a row per word.
4. Blocks of more than LARGE words are dealt to chunks, each pair of which meets in a task of its own.

Forms are followed to the last by pointer doubling: a form has ten times its word's count, so chains are short.

Defined results: null texts have no words; a null id counts as an empty one where the id is hashed; rows that share an
id are hashed alike and counted each; very long texts and words are used whole; of near words with equal counts the
first in code-point order is meant; no words give an empty table; other columns may have any names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, TWICE, DROPS, RATIO = 7, 2, 31, 10
Q = 2
PIECES = 4
LARGE = 20_000  # words of a block that one task takes
LISTED = 1_000_000  # keys of larger blocks that are broadcast


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """(word, n) of words with `least` letters and `twice` occurrences or more."""
    some = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    # Deleting a letter shortens, so shorter runs can be left out at once.
    runs = some.select("id", F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{least},}})"), F.lit(1))).alias("run"))
    # Where nothing changes in lower case there are no capitals to change.
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    lowered = runs.select("id", low.alias("w"))
    hashed = lowered.select("w", F.crc32(F.concat("id", F.lit(":"), "w").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("w")).cast("int")
    cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    words = hashed.select(F.when(F.col("h") % DROPS == 0, cut).otherwise(F.col("w")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def cuts(m: int) -> list[int]:
    """Where the pieces of a word of m letters begin, and its end."""
    return [m * j // PIECES for j in range(PIECES + 1)]


def _posted(words: DataFrame, least: int) -> DataFrame:
    """(key, m, hole, word, n): each word under the letters around each piece, as one of m letters and as the longer one."""

    def under(m: Column, hole: int) -> Column:
        before = F.floor(m * hole / PIECES).cast("int")
        after = m - F.floor(m * (hole + 1) / PIECES).cast("int")
        start = F.substring(F.col("word"), F.lit(1), before)
        end = F.when(after > 0, F.substring(F.col("word"), F.length("word") - after + 1, after)).otherwise("")
        return F.struct(F.xxhash64(m, F.lit(hole), start, end).alias("key"), m.alias("m"), F.lit(hole).alias("hole"))

    size = F.length("word")
    own = [under(size, hole) for hole in range(PIECES)]
    longer = [F.when(size > least, under(size - 1, hole)) for hole in range(PIECES)]
    return words.select("word", "n", F.explode(F.array_compact(F.array(*own, *longer))).alias("p")).select("p.*", "word", "n")


def near(a: str, b: str) -> tuple[int, int] | None:
    """The common beginning and end of two words, if one edit lies between; a is the shorter or as long."""
    if len(b) - len(a) > 1 or a == b:
        return None
    start, most = 0, len(a)
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most and a[-1 - end] == b[-1 - end]:
        end += 1
    # Beginning and end may overlap where letters repeat; together they must leave one letter at most.
    return (start, end) if start + end >= len(b) - 1 else None


def first_hole(a: str, start: int, end: int) -> int:
    """The first piece of the shorter word that can hold the edit between it and a near word."""
    at = cuts(len(a))
    return next(j for j in range(PIECES) if at[j] <= start and len(a) - at[j + 1] <= end)


class Block:
    """An inverted index of the q-grams around one piece: (gram, place, one of the longer words?) to words in order."""

    def __init__(self, words: list[str], m: int, hole: int):
        at = cuts(m)
        self.words, self.m, self.hole = words, m, hole
        self.start, self.end = at[hole], m - at[hole + 1]
        self.piece = at[hole + 1] - at[hole]
        # With a piece of one letter the bound is nought; a gram of the shared beginning then gathers all of the block.
        self.more = 1 if self.piece < Q else 0
        self.lists: dict[tuple[str, int, bool], list[int]] = defaultdict(list)

    def grams(self, word: str) -> list[str]:
        padded = "^" * Q + word + "$"
        part = padded[self.start + 1 - self.more : len(word) - self.end + Q + 1]
        return [part[k : k + Q] for k in range(len(part) - Q + 1)]

    def add(self, k: int, grams: list[str]) -> None:
        longer = len(self.words[k]) > self.m
        for place, gram in enumerate(grams):
            self.lists[gram, place, longer].append(k)

    def candidates(self, grams: list[str], longer: bool) -> Iterator[int]:
        """Words added so far, as long as the one with these grams or longer by one, that share enough of them."""
        found = []
        for place, gram in enumerate(grams):
            for shifted in (place, place + 1) if longer else (place,):
                if here := self.lists.get((gram, shifted, longer)):
                    found.append(here)
        least = self.piece + longer - 1 + self.more
        if len(found) < least:
            return
        last, times = -1, 0
        for k in heapq.merge(*found) if len(found) > 1 else found[0]:
            if k == last:
                times += 1
            else:
                last, times = k, 1
            if times == least:
                yield k


def _meet(words: list[str], counts: list[int], chunk: list[bool] | None, m: int, hole: int) -> dict[int, list]:
    """Per word with near words here: how many, the greatest count and the word that has it. chunk tells the words of
    the first chunk from those of the second, where a block is met in parts."""
    block = Block(words, m, hole)
    out: dict[int, list] = {}

    def tell(k: int, other: int) -> None:
        n, w = counts[other], words[other]
        have = out.get(k)
        if have is None:
            out[k] = [1, n, w]
            return
        have[0] += 1
        if n > have[1] or (n == have[1] and w < have[2]):
            have[1], have[2] = n, w

    # Longer words first, so that each of the others meets them and those before it.
    for k in sorted(range(len(words)), key=lambda k: -len(words[k])):
        word, grams = words[k], block.grams(words[k])
        for longer in (False, True) if len(word) == m else ():
            for other in block.candidates(grams, longer):
                if chunk and chunk[k] == chunk[other]:
                    continue
                common = near(word, words[other])
                if common and first_hole(word, *common) == hole:
                    tell(k, other)
                    tell(other, k)
        block.add(k, grams)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block; a block may go over several batches."""
    held: list[tuple] = []
    current = None
    out: dict[str, list] = {"word": [], "near": [], "most": [], "best": []}

    def settle() -> None:
        if len(held) < 2:
            return
        words, counts = [r[0] for r in held], [r[1] for r in held]
        _, m, hole, i, j = current
        chunk = [r[2] == i for r in held] if i != j else None
        for k, (times, most, best) in _meet(words, counts, chunk, m, hole).items():
            for column, value in zip(out.values(), (words[k], times, most, best)):
                column.append(value)

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out["word"], pa.string()), pa.array(out["near"], pa.int64()), pa.array(out["most"], pa.int64()), pa.array(out["best"], pa.string())], list(out))
        for column in out.values():
            column.clear()
        return made

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("key", "m", "hole", "i", "j", "word", "n", "c")]
        for key, m, hole, i, j, word, n, c in zip(*columns):
            if (key, m, hole, i, j) != current:
                settle()
                held, current = [], (key, m, hole, i, j)
            held.append((word, n, c))
        if len(out["word"]) >= 5000:
            yield flush()
    settle()
    yield flush()


def near_words(words: DataFrame, least: int = LEAST) -> DataFrame:
    """Over (word, n), words being distinct: (word, n_near, most, best) of those that have near words; best is the near word of
    the greatest count, `most`."""
    posted = _posted(words, least)
    large = durable(posted.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > LARGE))
    listed = large.count()
    sized = posted.join(F.broadcast(large) if listed <= LISTED else large, "key", "left") if listed else posted.withColumn("size", F.lit(1).cast("long"))
    dealt = sized.withColumn("s", F.ceil(F.coalesce("size", F.lit(1)) / LARGE).cast("int")).withColumn("c", F.pmod(F.xxhash64(F.lit(3), "word"), F.col("s")).cast("int"))
    cells = dealt.select("key", "m", "hole", "word", "n", "c", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("o"))
    cells = cells.select("key", "m", "hole", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "word", "n", "c")
    block = ["key", "m", "hole", "i", "j"]
    met = cells.repartition("key", "i", "j").sortWithinPartitions(*block, "word").mapInArrow(_blocks, "word string, near long, most long, best string")
    best = F.min(F.struct((-F.col("most")).alias("less"), "best")).alias("b")
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("most"), "b.best")


def roots(forms: DataFrame, rounds: int = 8) -> DataFrame:
    """Over (word, form): (word, root), the last of the forms that follow one another. Each round doubles the steps."""
    at = durable(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = durable(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return at
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, twice: int = TWICE, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = durable(word_counts(docs, id_col, text_col, least, twice))
    found = words.join(near_words(words, least), "word", "left")
    is_form = F.col("most") >= ratio * F.col("n")
    table = durable(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("most")).alias("form_n")))
    last = roots(table.where("form is not null").select("word", "form"))
    return table.join(last, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "form", "root", "n", "n_near", "form_n")

"""From texts to pages, positioned words, chunks and token-budget spans.

All folds run over arrays of bounded size (a page of ``PAGE_WORDS`` words), one
row per page, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions.text import SENTENCE_END, collapse, quality, words

PAGE_WORDS = 300
CHUNK_WORDS, BOUNDARY_WORDS = 120, 90


def _page_starts(word_array: Column) -> Column:
    return F.when(F.size(word_array) > 0, F.sequence(F.lit(0), F.size(word_array) - 1, F.lit(PAGE_WORDS))).otherwise(F.array(F.lit(0)))


def pages(documents: DataFrame) -> DataFrame:
    """``doc_id, source, page_index, page_words, page_text``: slices of PAGE_WORDS words of the canonical text."""
    split = documents.select("doc_id", "source", words(collapse(F.col("text"))).alias("w"))
    cut = split.select("doc_id", "source", F.posexplode(F.transform(_page_starts(F.col("w")), lambda s: F.slice(F.col("w"), s + 1, PAGE_WORDS))).alias("page_index", "page_words"))
    return cut.withColumn("page_text", F.array_join("page_words", " "))


def placed_pages(documents: DataFrame) -> DataFrame:
    """``doc_id, page_index, page_base, document_length``: where each page starts in its document, in characters.

    Pages are joined by one separator, which counts. All sums are over the pages
    of one row, so nothing is shuffled; a null or blank text is one empty page.
    """
    page_lengths = F.transform(_page_starts(F.col("w")), lambda s: F.length(F.array_join(F.slice(F.col("w"), s + 1, PAGE_WORDS), " ")))
    sums = lambda n: F.struct(running_sums(F.transform(n, lambda x: x + 1)).alias("bases"), (F.aggregate(n, F.lit(0), lambda a, x: a + x) + F.size(n) - 1).alias("total"))
    split = documents.select("doc_id", words(collapse(F.col("text"))).alias("w")).select("doc_id", let(page_lengths, sums).alias("x"))
    return split.select("doc_id", F.posexplode("x.bases").alias("page_index", "page_base"), F.col("x.total").cast("long").alias("document_length")).withColumn("page_base", F.col("page_base").cast("long"))


def starts_early(start: Column, length: Column) -> Column:
    """Whether a place lies in the first quarter of its document, by whole numbers: 4 x start < length."""
    return 4 * start < length


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (inside a lambda Spark evaluates outer expressions anew)."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column, depth: int = 2, block: int = 32) -> Column:
    """For each number the sum of those before it.

    A fold that appends copies its array for every element, so it runs over
    blocks of ``block`` numbers only; their sums are the blocks' bases, found in
    the same way ``depth`` times.
    """

    def folded(numbers: Column, base: Column) -> Column:
        start = F.struct(base.cast("int").alias("at"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(numbers, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums")))["sums"]

    if depth == 0:
        return folded(values, F.lit(0))

    def blocked(numbers: Column) -> Column:
        starts = F.when(F.size(numbers) > 0, F.sequence(F.lit(1), F.size(numbers), F.lit(block))).when(F.size(numbers) == 0, F.array().cast("array<int>"))
        return let(F.transform(starts, lambda at: F.slice(numbers, at, block)), joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda acc, n: acc + n))
        return F.flatten(F.zip_with(blocks, running_sums(totals, depth - 1, block), folded))

    return let(values, blocked)


def offsets(word_array: Column) -> Column:
    """Start of each word in the words joined by single spaces."""
    return running_sums(F.transform(word_array, lambda w: F.length(w) + 1), 1)


def chunk_cuts(word_array: Column) -> Column:
    """Ends of greedy chunks: CHUNK_WORDS words, or earlier after the last sentence end from the BOUNDARY_WORDS-th word on."""

    def folded(page: Column) -> Column:
        n, start, ends = page["n"], F.struct(F.lit(0).alias("start"), F.array().cast("array<int>").alias("cuts")), page["ends"]

        def step(acc: Column, _: Column) -> Column:
            late = F.array_max(F.filter(ends, lambda e: (e >= acc["start"] + BOUNDARY_WORDS) & (e <= acc["start"] + CHUNK_WORDS)))
            end = F.when(n - acc["start"] <= CHUNK_WORDS, n).otherwise(F.coalesce(late, acc["start"] + CHUNK_WORDS))
            return F.when(acc["start"] >= n, acc).otherwise(let(end, lambda e: F.struct(e.alias("start"), F.concat(acc["cuts"], F.array(e)).alias("cuts"))))

        return F.aggregate(F.sequence(F.lit(1), F.ceil(n / BOUNDARY_WORDS).cast("int") + 1), start, step)["cuts"]

    # Each word is looked at once per page, not once per window.
    marked = F.transform(word_array, lambda w, i: F.when(w.rlike(SENTENCE_END), i + 1))
    return let(F.struct(F.size(word_array).alias("n"), F.array_compact(marked).alias("ends")), folded)


def adequate(page_rows: DataFrame) -> DataFrame:
    """Pages that need no other reading: all others give no chunks."""
    return page_rows.filter(quality(F.col("page_text"), F.size("page_words")) == "adequate")


def cut_pages(page_rows: DataFrame) -> DataFrame:
    """Adequate pages with ``starts`` (of their words) and ``chunks``: array of (ordinal, start_word, n_words, start_offset, end_offset)."""
    sized = adequate(page_rows).withColumn("starts", offsets(F.col("page_words"))).withColumn("cuts", chunk_cuts(F.col("page_words")))

    def chunk(end: Column, k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get("cuts", k - 1))
        last = F.get("page_words", end - 1)
        return F.struct(k.alias("ordinal"), begin.alias("start_word"), (end - begin).alias("n_words"), F.get("starts", begin).alias("start_offset"), (F.get("starts", end - 1) + F.length(last)).alias("end_offset"))

    return sized.withColumn("chunks", F.transform("cuts", chunk)).drop("cuts")


def chunks(page_rows: DataFrame) -> DataFrame:
    """``doc_id, source, page_index, ordinal, start_word, n_words, start_offset, end_offset, chunk_text``."""
    # An outer explode: for an inner one, Spark would add a filter that cuts every page once more.
    each = cut_pages(page_rows).select("doc_id", "source", "page_index", "page_words", F.explode_outer("chunks").alias("c")).filter("c IS NOT NULL")
    return each.select("doc_id", "source", "page_index", "c.*", F.array_join(F.slice("page_words", F.col("c.start_word") + 1, F.col("c.n_words")), " ").alias("chunk_text"))


def budget_spans(word_array: Column, cost, budget: int) -> Column:
    """Greedy spans of words whose costs stay within a budget: array of (start, end, embeddable).

    A single word over the budget becomes a span of its own that is not embeddable.
    """
    span = "struct<s:int,e:int,ok:boolean>"
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("open"), F.lit(0).alias("used"), F.array().cast(f"array<{span}>").alias("done"))

    def made(s: Column, e: Column, ok: bool) -> Column:
        return F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), F.lit(ok).alias("ok")))

    def step(acc: Column, w: Column) -> Column:
        i, c = acc["i"], cost(w)
        closed = F.when(i > acc["open"], F.concat(acc["done"], made(acc["open"], i, True))).otherwise(acc["done"])
        fits = acc["used"] + c <= budget
        return (
            F.when(c > budget, F.struct((i + 1).alias("i"), (i + 1).alias("open"), F.lit(0).alias("used"), F.concat(closed, made(i, i + 1, False)).alias("done")))
            .when(fits, F.struct((i + 1).alias("i"), acc["open"].alias("open"), (acc["used"] + c).alias("used"), acc["done"].alias("done")))
            .otherwise(F.struct((i + 1).alias("i"), i.alias("open"), c.alias("used"), closed.alias("done")))
        )

    return F.aggregate(word_array, start, step, lambda acc: F.when(acc["i"] > acc["open"], F.concat(acc["done"], made(acc["open"], acc["i"], True))).otherwise(acc["done"]))


def line_order(placed: Column, tolerance: float = 3.0) -> Column:
    """Positioned words (top, x0, w) as lines in reading order.

    Words go by their top; one within ``tolerance`` of the first top of the
    current line belongs to it, else it starts a line. Within a line words go
    by x0, then by top. Only the different tops of a page are folded.
    """

    def starts(words: Column) -> Column:
        tops = F.sort_array(F.array_distinct(F.transform(words, lambda w: w["top"].cast("double"))))
        step = lambda acc, t: F.when((F.size(acc) > 0) & (t - F.get(acc, F.size(acc) - 1) <= tolerance), acc).otherwise(F.concat(acc, F.array(t)))
        return F.aggregate(tops, F.array().cast("array<double>"), step)

    def lines(words: Column, first: Column) -> Column:
        def line(top: Column, i: Column) -> Column:
            below = F.get(first, i + 1)
            mine = F.filter(words, lambda w: (w["top"] >= top) & (below.isNull() | (w["top"] < below)))
            return F.sort_array(F.transform(mine, lambda w: F.struct(w["x0"].alias("x0"), w["top"].alias("top"), w["w"].alias("w"))))

        return F.transform(first, line)

    return let(placed, lambda words: let(starts(words), lambda first: lines(words, first)))

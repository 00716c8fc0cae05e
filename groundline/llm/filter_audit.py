"""How five filters interact: for every order of applying them, what each step removes, and each filter's Shapley value.

A document fails a set of filters, a mask of five bits. A coalition S of
filters removes v(S) documents: those that fail one of S at least. The game v
has one Hart-Mas-Colell potential P with P(empty) = 0 and
``P(S) = (v(S) + sum of P(S without i) over i in S) / |S|``, computed over the
32 coalitions in the order of their numbers, so that every smaller one comes
first. The Shapley value of filter i is P(all) - P(all without i). 120 P is a
whole number, so the sum over all 120 orders is exact. What a step removes is a
difference of two coalitions: those of the filters up to it and before it.

Only counts per part and mask meet; texts stay where they are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, cut, let

FILTERS = "ABCDE"
#: The bit of E, whose verdict depends on other documents.
COPY = 1 << FILTERS.index("E")
ALL = (1 << len(FILTERS)) - 1


def text_mask(text: Column) -> Column:
    """Which of the filters A to D a text fails, as bits 0 to 3."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        few = F.size(words) < 100
        repeated = 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long")
        return F.when(few, 1).otherwise(0) + F.when(repeated, 2).otherwise(0)

    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    loud = 100 * capitals.cast("long") > 10 * F.length(text).cast("long")
    return let(ascii_words(text), of_words) + F.when(loud, 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents of each part fail exactly the filters of each mask.

    Of equal texts, all but the row with the smallest doc_id fail E: a row
    passes if its id is the least of its text. Ids are compared in full; the
    join is by text digest and id together, so copies of one text are spread.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_mask(F.col("text")).alias("mask")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic"))
    judged = rows.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.lit(COPY)).otherwise(0)
    return judged.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def coalitions(counts: DataFrame) -> DataFrame:
    """One row per part: ``total`` documents, ``v`` (32 structs ``n, good, toxic``: what coalition 0 to 31 removes) and ``potential`` (32 longs, times 120)."""
    masks = F.sequence(F.lit(0), F.lit(ALL))
    # A mask's documents are removed by every coalition that has one of its filters.
    removed = counts.select("part", "mask", "n", "good", "toxic", F.explode(masks).alias("s"))
    hit = F.col("mask").bitwiseAND(F.col("s")) != 0
    sums = removed.groupBy("part", "s").agg(*(F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")), F.sum("n").alias("total"))
    games = sums.groupBy("part").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("v"))

    def next_potential(found: Column, s: Column) -> Column:
        without = [F.when(s.bitwiseAND(F.lit(1 << k)) != 0, F.get(found, s - (1 << k))).otherwise(F.lit(0)) for k in range(len(FILTERS))]
        whole = 120 * F.get(F.col("v"), s)["n"] + sum(without[1:], without[0])
        return F.concat(found, F.array(F.call_function("div", whole, F.bit_count(s).cast("long"))))

    return games.withColumn("potential", F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), next_potential))


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (language; null is the empty string), order of the filters and step.

    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``; the filter of a step is that letter of the
    order. ``shapley`` is the filter's Shapley value times 120, which is the sum
    over all orders of what it removes. Null and empty texts fail A alone (and E
    as copies of each other); texts of any length count whole; rows with the
    least id of their text, repeated ones too, pass E, as do rows without an id,
    which are no copy's original either; a document is good or toxic if a label
    row says so; other columns are ignored; an empty table has no part.
    """
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = F.sequence(F.lit(1), F.lit(len(FILTERS)))
    bit = lambda k: F.call_function("shiftleft", F.lit(1), F.ascii(F.substr("filter_order", k, F.lit(1))) - ord(FILTERS[0]))
    games = coalitions(failures(documents, labels))
    rows = games.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(steps).alias("step"))
    before = F.aggregate(steps, F.lit(0), lambda acc, k: acc + F.when(k < F.col("step"), bit(k)).otherwise(0))
    rows = rows.withColumn("own", bit(F.col("step"))).withColumn("before", before).withColumn("after", F.col("before") + F.col("own"))
    of = lambda s, name="n": F.get(F.col("v"), F.col(s) if isinstance(s, str) else s)[name]
    rest = F.lit(ALL) - F.col("own")
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - of("after")).alias("kept"),
        (of("after") - of("before")).alias("removed"),
        (of("own") - of("after") + of("before")).alias("redundant"),
        (of(F.lit(ALL)) - of(rest)).alias("unique_fails"),
        (of("after", "good") - of("before", "good")).alias("good_lost"),
        (of("after", "toxic") - of("before", "toxic")).alias("toxic_lost"),
        (F.get("potential", F.lit(ALL)) - F.get("potential", rest)).alias("shapley"),
    )

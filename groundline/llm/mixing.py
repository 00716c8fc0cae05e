"""Temperature mixing of sources. DataFrame functions only.

A source's weight is its token share raised to an exponent, normalised. The
exponent is bisected between 0 (equal weights) and 1 (natural shares): it is
the greatest at which the weights reach ``target_entropy`` (as a fraction of
the greatest possible), raised further where a source would else be repeated
more than ``max_epochs`` times. The weights are then realised in whole
documents: each source is dealt into blocks, the blocks are put in the order
of a seeded permutation, and blocks are taken until the source's budget is
spent; the block at the boundary is taken document by document.

The sources' totals meet in one array, where the exponent is bisected as one
expression. Beyond ``max_sources`` of them the same exponent is found by
aggregations over their table, each of which tries several exponents at once.

Totals are counted per source and block before anything is ordered, so a
source that holds a third of all rows costs as many ordered rows as it has
blocks, and no task sees more than one block's documents together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, let, numbered

TOKEN = r"[^\x20\x09-\x0D]+"


def _log_shares_to_weights(logs: Column, exponent: Column) -> Column:
    """Normalised exp(exponent * log share) of an array of log shares."""
    raw = F.transform(logs, lambda x: F.exp(x * exponent))
    return let(raw, lambda r: let(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(r, lambda x: x / total)))


def _entropy(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda acc, w: acc - F.when(w > 0, w * F.log(w)).otherwise(F.lit(0.0)))


def source_weights(tokens: DataFrame, *, target_entropy: float, max_epochs: float, budget: int | None, rounds: int = 50, max_sources: int = 100_000) -> DataFrame:
    """``source, tokens, exponent, weight, budget_tokens`` per source of ``tokens`` (``source, tokens``).

    Without ``budget`` the budget is the least that uses every source whole at
    least once. ``max_sources`` only decides whether the sources meet in one
    array. Sources without tokens have no row.
    """
    solve = _by_array if tokens.count() <= max_sources else _by_table
    weighted = solve(tokens, target_entropy, max_epochs, budget, rounds)
    share = F.round(F.col("weight") * F.col("budget")).cast("long")
    if budget is None:
        share = F.greatest(share, F.col("tokens"))  # rounding must not cost the whole first pass
    return weighted.select("source", "tokens", "exponent", "weight", F.least(share, F.floor(F.lit(float(max_epochs)) * F.col("tokens"))).alias("budget_tokens"))


def _by_array(tokens: DataFrame, target_entropy: float, max_epochs: float, budget: int | None, rounds: int) -> DataFrame:
    """``source, tokens, exponent, weight, budget``: all sources in one array, the bisections as expressions."""
    one = tokens.agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("all"))
    one = one.select(F.filter("all", lambda s: s["tokens"] > 0).alias("s")).withColumn("total", F.aggregate("s", F.lit(0).cast("long"), lambda acc, s: acc + s["tokens"]))
    one = one.withColumn("logs", F.transform("s", lambda s: F.log(s["tokens"] / F.col("total"))))
    size, logs = F.size("s"), F.col("logs")
    need = F.lit(float(target_entropy)) * F.log(F.greatest(size, F.lit(1)).cast("double"))

    def most_epochs(exponent: Column) -> Column:
        # Passes over the scarcest source; the budget follows from the most plentiful one unless it is given.
        per_source = let(_log_shares_to_weights(logs, exponent), lambda w: F.zip_with(w, F.col("s"), lambda x, s: x / s["tokens"]))
        given = F.array_max(per_source) * F.lit(budget if budget is not None else 0)
        return let(per_source, lambda p: F.array_max(p) / F.array_min(p)) if budget is None else given

    def bisect(ok) -> Column:
        """The greatest (ok at 0) or least (ok at 1) exponent, whichever side of the change is ok."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(acc: Column, _: Column) -> Column:
            return let((acc["lo"] + acc["hi"]) / 2, lambda mid: F.when(ok(mid), F.struct(mid.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi"))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)

    entropy_at = lambda e: _entropy(_log_shares_to_weights(logs, e))
    natural = F.lit(1.0)
    by_entropy = F.when(entropy_at(natural) >= need, natural).otherwise(bisect(lambda e: entropy_at(e) >= need)["lo"])
    by_epochs = F.when(most_epochs(F.lit(0.0)) <= max_epochs, F.lit(0.0)).otherwise(bisect(lambda e: most_epochs(e) > max_epochs)["hi"])
    one = one.withColumn("exponent", F.round(F.greatest(by_entropy, by_epochs), 9))
    one = one.withColumn("w", _log_shares_to_weights(logs, F.col("exponent")))
    whole = F.array_max(F.zip_with("s", "w", lambda s, w: s["tokens"] / w))
    one = one.withColumn("budget", F.lit(float(budget)) if budget is not None else whole)
    rows = one.select("exponent", "budget", F.explode(F.arrays_zip("s", "w")).alias("x"))
    return rows.select(F.col("x.s.source").alias("source"), F.col("x.s.tokens").alias("tokens"), "exponent", F.round("x.w", 9).alias("weight"), F.col("budget"))


def _by_table(tokens: DataFrame, target_entropy: float, max_epochs: float, budget: int | None, rounds: int, at_once: int = 15) -> DataFrame:
    """The same by aggregations over the table of sources: the interval is cut in ``at_once + 1`` parts by each."""
    some = tokens.filter("tokens > 0")
    size, total = some.agg(F.count("*"), F.sum("tokens")).first()
    logs = F.log(F.col("tokens") / F.lit(float(total)))
    need = target_entropy * math.log(max(1, size))

    def tried(exponents: list[float]) -> list[tuple[float, float]]:
        """Entropy and passes over the scarcest source at each exponent."""
        columns = []
        for e in exponents:
            raw = F.exp(logs * F.lit(e))
            columns += [F.sum(raw), F.sum(raw * logs), F.max(raw / F.col("tokens")), F.min(raw / F.col("tokens"))]
        found = some.agg(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()
        four = [found[4 * k : 4 * k + 4] for k in range(len(exponents))]
        return [(math.log(z) - e * weighted / z, most / least if budget is None else most / z * budget) for e, (z, weighted, most, least) in zip(exponents, four)]

    def change(ok) -> tuple[float, float]:
        """The ends of an interval in which ``ok`` changes, no longer than that of ``rounds`` bisections."""
        low, high, first = 0.0, 1.0, ok(0.0, *tried([0.0])[0])
        while high - low > 2.0**-rounds:
            inner = [low + (high - low) * k / (at_once + 1) for k in range(1, at_once + 1)]
            same = [ok(e, *x) == first for e, x in zip(inner, tried(inner))]
            edges = [low, *inner, high]
            k = same.index(False) if False in same else at_once
            if (edges[k], edges[k + 1]) == (low, high):
                break
            low, high = edges[k], edges[k + 1]
        return low, high

    (entropy, _), (_, epochs) = tried([1.0])[0], tried([0.0])[0]
    by_entropy = 1.0 if entropy >= need else change(lambda _, h, __: h >= need)[0]
    by_epochs = 0.0 if epochs <= max_epochs else change(lambda _, __, n: n > max_epochs)[1]
    exponent = round(max(by_entropy, by_epochs), 9)
    z, most = some.agg(F.sum(F.exp(logs * F.lit(exponent))), F.max(F.col("tokens") / F.exp(logs * F.lit(exponent)))).first()
    whole = float(budget) if budget is not None else most * z
    return some.select("source", "tokens", F.lit(exponent).alias("exponent"), F.round(F.exp(logs * F.lit(exponent)) / F.lit(z), 9).alias("weight"), F.lit(whole).alias("budget"))


def mix(documents: DataFrame, *, target_entropy: float = 0.93, max_epochs: float = 4.0, budget: int | None = None, block_tokens: int = 100_000, max_blocks: int = 65_536, max_sources: int = 100_000, seed: int = 17) -> DataFrame:
    """``row, doc_id, source, n_tokens, exponent, weight, block, n_copies`` of every row.

    n_copies is how often the mixture uses the document: the whole passes that
    the source's budget pays for, and one more if the document lies before the
    cut of the last, partial pass. Null sources are a source of their own; null
    and empty texts have no tokens and come once a whole pass; repeated rows
    count as rows; texts of any length are counted whole; other columns are
    ignored; an empty table gives an empty result. ``row`` is the number that
    ``numbered`` gives. A source has a block for each ``block_tokens`` tokens; one
    with more than ``max_blocks`` of them gets as many larger blocks. Beyond
    ``max_sources`` sources, their table is joined instead of broadcast.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut(numbered(documents.select("doc_id", "source", "text")).select("row", "doc_id", "source", F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("n_tokens")))
    base = base.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
    totals = cut(base.groupBy(F.col("key").alias("source")).agg(F.sum("n_tokens").alias("tokens")))
    weights = cut(source_weights(totals, target_entropy=target_entropy, max_epochs=max_epochs, budget=budget, max_sources=max_sources)).withColumnRenamed("source", "key")
    weights = weights.withColumn("n_blocks", F.least(F.lit(max_blocks), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("int"))
    # Whole passes over a source, and the tokens that are left for the partial one.
    weights = weights.withColumn("passes", F.floor(F.col("budget_tokens") / F.col("tokens"))).withColumn("rest", F.col("budget_tokens") - F.col("passes") * F.col("tokens")).drop("tokens")
    known = F.broadcast(weights) if totals.count() <= max_sources else weights
    order = F.xxhash64("doc_id", "row", F.lit(seed))
    dealt = base.join(known, "key", "left").withColumn("block", F.pmod(order, F.greatest(F.lit(1), F.coalesce("n_blocks", F.lit(1)))).cast("int")).withColumn("order", order)
    blocks = dealt.filter("rest > 0").groupBy("key", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("rest").alias("rest"))
    permuted = Window.partitionBy("key").orderBy(F.xxhash64("block", "key", F.lit(seed)), "block")
    blocks = blocks.withColumn("before", F.sum("block_tokens").over(permuted) - F.col("block_tokens"))
    # Only the block in which the budget ends has to be ordered by document.
    ends = blocks.filter("before < rest AND before + block_tokens > rest").select("key", "block", F.col("before").alias("end_before"))
    whole = blocks.filter("before + block_tokens <= rest").select("key", "block", F.lit(1).alias("whole"))
    inside = Window.partitionBy("key", "block").orderBy("order", "row")
    cut_rows = dealt.join(ends, ["key", "block"]).withColumn("upto", F.col("end_before") + F.sum("n_tokens").over(inside)).filter("upto <= rest").select(F.col("row"), F.lit(1).alias("extra"))
    marked = dealt.join(whole, ["key", "block"], "left").join(cut_rows, "row", "left")
    copies = F.coalesce("passes", F.lit(1)) + F.coalesce("whole", "extra", F.lit(0))
    return marked.select("row", "doc_id", "source", "n_tokens", "exponent", "weight", "block", copies.cast("int").alias("n_copies"))

"""Planning of word searches: terms under limits, and the branches of a multi-query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions.text import INTENTS, STOP_WORDS, TOKEN, collapse, nfc, variants, words

#: Limits of a search and of its branches. Fixed values.
MAX_QUERY_BYTES, MAX_SPANS, MAX_TOKENS, MAX_TERM_LENGTH, MAX_TERM_BYTES, MAX_TERMS, MAX_EXPRESSION_BYTES = 4096, 128, 256, 64, 128, 32, 8192
MAX_FAMILIES, MAX_EXPANDED, MAX_BRANCHES = 2, 64, 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def literals(items) -> Column:
    return F.array(*map(F.lit, items))


def expression_bytes(terms: Column) -> Column:
    """Bytes of the terms in quotes joined by `` OR ``."""
    return F.octet_length(F.array_join(terms, "")) + 6 * F.size(terms) - 4


def plan(queries: DataFrame, key: str, text: str) -> DataFrame:
    """``key, terms, state``: distinct terms in order without function words, and whether the search is admitted.

    state is ``ok`` or the first reason against the search: ``resource_limit``,
    ``unsupported_characters``, ``no_terms``. A null text has no terms.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lowered = F.translate(nfc(whole), _UPPER, _LOWER)
    split = queries.select(key, whole.alias("whole"), lowered.alias("lowered")).withColumn("all", F.regexp_extract_all("lowered", F.lit(TOKEN), 0))
    split = split.withColumn("terms", F.array_except("all", literals(STOP_WORDS)))
    odd = F.replace(F.replace(F.replace("whole", F.lit("\t"), F.lit("")), F.lit("\n"), F.lit("")), F.lit("\r"), F.lit("")).rlike(r"[\p{Cc}\p{Cf}]")
    long = F.exists("all", lambda t: (F.length(t) > MAX_TERM_LENGTH) | (F.octet_length(t) > MAX_TERM_BYTES))
    state = (
        F.when((F.octet_length("whole") > MAX_QUERY_BYTES) | (F.size(words(collapse(F.col("whole")))) > MAX_SPANS), "resource_limit")
        .when(odd, "unsupported_characters")
        .when((F.octet_length("lowered") > MAX_QUERY_BYTES) | (F.size("all") > MAX_TOKENS) | long, "resource_limit")
        .when(F.size("terms") == 0, "no_terms")
        .when((F.size("terms") > MAX_TERMS) | (expression_bytes(F.col("terms")) > MAX_EXPRESSION_BYTES), "resource_limit")
        .otherwise("ok")
    )
    return split.select(key, "terms", state.alias("state"))


def branches(plans: DataFrame, key: str) -> DataFrame:
    """``key, state, branches`` of admitted plans: array of (place, branch_id, kind, terms, aliases).

    The base branch has the plan's terms; each variant of a term and each intent
    family that a term calls make one more, which adds to the base terms. Of
    branches with the same terms the first stays and names the others. Too many
    families, expanded terms or branches reject the search (``resource_limit``).
    """
    branch = "struct<branch_id:string,kind:string,terms:array<string>>"
    terms, stop = F.col("terms"), literals(STOP_WORDS)

    def made(branch_id: Column, kind: str, added: Column) -> Column:
        return F.struct(branch_id.alias("branch_id"), F.lit(kind).alias("kind"), F.array_except(F.concat(terms, added), stop).alias("terms"))

    number = lambda i: F.lpad(i.cast("string"), 3, "0")
    formed = F.transform(terms, lambda t, i: F.transform(variants(t), lambda v, k: made(F.concat(F.lit("morphology-"), number(i), F.lit("-"), number(k)), "morphology", F.array(v))))
    families = F.array_compact(F.array(*(F.when(F.arrays_overlap(terms, literals(calls)), F.struct(F.lit(f).alias("family"), literals(adds).alias("adds"))) for f, (calls, adds) in INTENTS.items())))
    called = F.transform(F.col("families"), lambda f, i: made(F.concat(F.lit("intent-"), number(i), F.lit("-"), f["family"]), "intent", f["adds"]))
    admitted = plans.filter("state = 'ok'").withColumn("families", families)
    base = F.array(made(F.lit("base-000"), "base", F.array().cast("array<string>")))
    expanded = F.size("terms") + F.size("formed") + F.aggregate("families", F.lit(0), lambda acc, f: acc + F.size(f["adds"]))
    rows = admitted.withColumn("formed", F.flatten(formed)).withColumn("pending", F.concat(base, F.col("formed"), called).cast(f"array<{branch}>"))
    same = lambda b, c: F.array_join(b["terms"], " ") == F.array_join(c["terms"], " ")
    first = F.filter("pending", lambda b, i: ~F.exists(F.slice("pending", 1, i), lambda c: same(b, c)))
    aliases = lambda b: F.transform(F.filter("pending", lambda c: same(b, c) & (b["branch_id"] != c["branch_id"])), lambda c: c["branch_id"])
    named = F.transform(F.col("first"), lambda b, i: F.struct(i.alias("place"), b["branch_id"].alias("branch_id"), b["kind"].alias("kind"), b["terms"].alias("terms"), aliases(b).alias("aliases")))
    rows = rows.withColumn("first", first)
    too_long = F.exists("first", lambda b: (F.size(b["terms"]) > MAX_TERMS) | (expression_bytes(b["terms"]) > MAX_EXPRESSION_BYTES))
    too_many = (F.size("families") > MAX_FAMILIES) | (expanded > MAX_EXPANDED) | (F.size("first") > MAX_BRANCHES)
    state = F.when(too_many | too_long, "resource_limit").otherwise("ok")
    return rows.select(key, state.alias("state"), named.alias("branches"))

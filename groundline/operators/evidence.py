"""Evidence: references, their resolution, packing under budgets, verification by exact text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions.text import tokens

#: Bytes of an empty preview. Fixed value.
EMPTY_BYTES = 77
#: Most bytes of a canonical JSON output. Fixed value.
MAX_JSON_BYTES = 4 * 1024 * 1024 - 1
#: Codes of a reference's resolution, in the order in which they are looked for. Fixed values.
CODES = (
    "INVALID_REQUEST RESOURCE_LIMIT SOURCE_NOT_FOUND SOURCE_SCOPE_MISMATCH GENERATION_NOT_CURRENT REFERENCE_NOT_FOUND "
    "RANGE_MISMATCH TEXT_DIGEST_MISMATCH ANCHOR_MISMATCH VECTOR_UNAVAILABLE VECTOR_NOT_CURRENT VECTOR_INTEGRITY INVALID_ORDER CONTRADICTORY_DUPLICATE"
).split()


def resolution_code(failed: dict[str, Column]) -> Column:
    """The first of ``CODES`` whose condition holds, or ``ok``; a condition that is null does not hold."""
    if unknown := failed.keys() - set(CODES):
        raise ValueError(f"no such codes: {sorted(unknown)}")
    code = None
    for name in CODES:
        if name in failed:
            code = F.when(failed[name], name) if code is None else code.when(failed[name], name)
    return F.lit("ok") if code is None else code.otherwise("ok")


def best_chunks(hits: DataFrame, chunk_rows: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Of each hit (``key, doc_id, rank``) the chunk with the most different terms of the search, the first of equal ones.

    ``terms`` has ``key, terms``. Only chunks of hit documents are needed in
    ``chunk_rows``. A hit without chunks has no row.
    """
    sized = chunk_rows.withColumn("words", F.array_distinct(tokens(F.col("chunk_text"))))
    met = hits.join(terms, key).join(sized, "doc_id").withColumn("n", F.size(F.array_intersect("words", "terms")))
    place = F.struct(-F.col("n"), F.col("page_index"), F.col("ordinal"))
    carried = [c for c in chunk_rows.columns if c != "doc_id"]
    best = met.groupBy(key, "doc_id", "rank").agg(F.min_by(F.struct(*carried), place).alias("c"))
    return best.select(key, "doc_id", "rank", "c.*")


def entry_json(label: Column, doc_id: Column, text: Column) -> Column:
    """An entry of a bundle as canonical JSON: fields in alphabetical order, no blanks, text escaped."""
    return F.to_json(F.struct(doc_id.alias("doc"), label.alias("label"), text.alias("text")))


def pack(candidates: DataFrame, key: str, *, max_bytes: int, max_entries: int, unit: str = "rank") -> DataFrame:
    """``key, doc_id, rank, label, disposition`` of at most some hundred candidates (``rank, doc_id, text``) per key.

    Candidates with one ``unit`` go in together or not at all. In the order of
    units, one is packed if its entries still fit; one that does not is passed
    over and later, smaller ones are tried. Labels number the packed entries.
    """
    members = candidates.groupBy(key, F.col(unit).alias("unit")).agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("rows"))
    units = members.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("unit", "rows"))).alias("units"))
    done = "array<struct<doc_id:bigint,rank:int,label:string,disposition:string>>"
    start = F.struct(F.lit(EMPTY_BYTES).alias("used"), F.lit(0).alias("n"), F.array().cast(done).alias("done"))
    label = lambda n: F.concat(F.lit("E"), n.cast("string"))

    def step(acc: Column, u: Column) -> Column:
        rows = u["rows"]
        sizes = F.transform(rows, lambda r, i: F.octet_length(entry_json(label(acc["n"] + i + 1), r["doc_id"], r["text"])) + F.when(acc["n"] + i > 0, 1).otherwise(0))
        size = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
        crowded = acc["n"] + F.size(rows) > max_entries
        fits = ~crowded & (acc["used"] + size <= max_bytes)
        why = F.when(crowded, "entry_limit").when(fits, "packed").otherwise("byte_limit")
        made = F.transform(rows, lambda r, i: F.struct(r["doc_id"].alias("doc_id"), r["rank"].cast("int").alias("rank"), F.when(fits, label(acc["n"] + i + 1)).alias("label"), why.alias("disposition")))
        return F.struct((acc["used"] + F.when(fits, size).otherwise(0)).alias("used"), (acc["n"] + F.when(fits, F.size(rows)).otherwise(0)).alias("n"), F.concat(acc["done"], made).alias("done"))

    return units.select(key, F.explode(F.aggregate("units", start, step)["done"]).alias("x")).select(key, "x.*")


def bundle_state(n_packed: Column, n_candidates: Column) -> Column:
    return F.when(n_packed == 0, F.when(n_candidates == 0, "no_candidates").otherwise("budget_too_small")).when(n_packed < n_candidates, "partial").otherwise("ready")


def sealed(body: Column) -> Column:
    """The fingerprint of a canonical JSON text, null if the text is over the bound: all or nothing."""
    return F.when(F.octet_length(body) <= MAX_JSON_BYTES, F.sha2(body, 256))


#: The policy under which proposals are verified, and the most bytes of a proposed value. Fixed values.
POLICY, MAX_VALUE_BYTES = "exact-source-text-v1", 2000


def verify_proposals(proposals: DataFrame, entries: DataFrame, fingerprints: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """``key, outcome, code`` of each proposal (``key, policy, fingerprint, labels, value``; one per key) against its bundle.

    ``entries`` has ``key, label, unit, doc_id, text`` of the packed entries,
    ``fingerprints`` the bundle's ``key, fingerprint``, ``current`` the ``doc_id``
    of documents that are current now. The first rule that is broken gives the
    code of a rejection: the request's form, its policy, its size, the bundle and
    the labels that it cites (known, each once), whole units, sources that are
    current at this moment. What is left is verified if the value is, byte for
    byte, the text of every cited entry, and else abstained from; so are values
    under units of two entries, which no rule projects to one.
    """
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    asked = proposals.select(key, "policy", "fingerprint", F.coalesce("value", F.lit("")).alias("value"), labels.alias("labels"))
    sizes = entries.groupBy(key, "unit").agg(F.count("*").alias("unit_size"))
    known = entries.join(sizes, [key, "unit"]).join(current.withColumn("is_current", F.lit(True)), "doc_id", "left")
    cited = asked.select(key, "value", F.explode(F.array_distinct("labels")).alias("label")).join(known, [key, "label"], "left")
    exact = F.encode("value", "UTF-8") == F.encode("text", "UTF-8")
    per_unit = cited.groupBy(key, "unit", "unit_size").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("unknown"), F.count_if(F.col("is_current").isNull()).alias("stale"), F.bool_and(exact).alias("exact"))
    found = per_unit.groupBy(key).agg(F.sum("unknown").alias("unknown"), F.bool_or(F.col("n") < F.col("unit_size")).alias("incomplete"), F.sum("stale").alias("stale"), F.max("unit_size").alias("largest"), F.bool_and("exact").alias("exact"))
    all_ = asked.join(found, key, "left").join(fingerprints.select(key, F.col("fingerprint").alias("true_fingerprint")), key, "left")
    faulty = ~F.col("fingerprint").eqNullSafe(F.col("true_fingerprint")) | (F.size(F.array_distinct("labels")) < F.size("labels")) | (F.col("unknown") > 0)
    rules = {
        "INVALID_REQUEST": (F.size("labels") == 0) | (F.trim("value") == "") | F.col("policy").isNull(),
        "POLICY_MISMATCH": F.col("policy") != POLICY,
        "RESOURCE_LIMIT": F.octet_length("value") > MAX_VALUE_BYTES,
        "EVIDENCE_REFERENCE_INVALID": faulty,
        "EVIDENCE_GROUP_INCOMPLETE": F.col("incomplete"),
        "SOURCE_NOT_CURRENT": F.col("stale") > 0,
        "EVIDENCE_GROUP_VALUE_PROJECTION_UNSUPPORTED": F.col("largest") > 1,
        "VALUE_NOT_EXACT_SOURCE_TEXT": ~F.col("exact"),
    }
    code = None
    for name, broken in rules.items():
        code = F.when(broken, name) if code is None else code.when(broken, name)
    abstained = list(rules)[-2:]
    outcome = F.when(F.col("code").isNull(), "verified").when(F.col("code").isin(abstained), "abstained").otherwise("rejected")
    return all_.select(key, code.alias("code")).select(key, outcome.alias("outcome"), "code")

"""Queries of data contracts: bounds, identifiers, lineage, manifests, normalised candidates, exact scores, citations, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.operators.ingest import chunks, line_order, pages
from groundline.operators.ranking import exact_percentiles
from groundline.plans.evidence import EVIDENCE_SQL, PACK_SQL, _evidence, _packed
from groundline.plans.ranking import FUSED_SQL, LEXICAL_SQL, SEMANTIC_SQL, fused, lexical, semantic
from groundline.plans.registry import query
from groundline.sources.checkpoints import cut
from groundline.sources.tables import table


@query("SELECT source, count(*) AS n_documents, sum(strlen(coalesce(text, '')))::BIGINT AS n_bytes, max(length(coalesce(text, '')))::INT AS longest, CASE WHEN max(length(coalesce(text, ''))) > 20000 THEN 'text_too_long' WHEN sum(strlen(coalesce(text, ''))) > 150000 THEN 'total_too_large' ELSE 'admitted' END AS verdict FROM documents GROUP BY source")
def size_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of each source against bounds, before any text is read out."""
    text = F.coalesce("text", F.lit(""))
    sized = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.octet_length(text)).alias("n_bytes"), F.max(F.length(text)).alias("longest"))
    return sized.withColumn("verdict", F.when(F.col("longest") > 20_000, "text_too_long").when(F.col("n_bytes") > 150_000, "total_too_large").otherwise("admitted"))


_UNSAFE = r"(^|/)\.{1,2}(/|$)|\\|:|//|^/|/$"


@query(rf"SELECT page_id, path, NOT regexp_matches(path, '{_UNSAFE}') AS safe FROM (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages)")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a url's path would be a safe relative path: no dot segments, colons, backslashes or empty segments."""
    path = F.regexp_extract("url", "://[^/]*/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), (~path.rlike(_UNSAFE)).alias("safe"))


@query("SELECT count(*) FILTER (lang IS NULL OR NOT regexp_matches(lang, '^[a-z]{2}$')) AS bad_lang, count(*) FILTER (source IS NULL OR NOT regexp_matches(source, '^src[0-9]+$')) AS bad_source, count(*) FILTER (NOT regexp_matches(sha256(text), '^[0-9a-f]{64}$')) AS bad_digest, count(*) FILTER (n_chars <> length(text)) AS bad_length, count(*) - count(DISTINCT doc_id) AS repeated_ids FROM documents")
def identifier_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of values that break the form of their column."""
    bad = lambda c, form: F.count_if(F.col(c).isNull() | ~F.col(c).rlike(form))
    return table(spark, sf_dir, "documents").agg(bad("lang", "^[a-z]{2}$").alias("bad_lang"), bad("source", "^src[0-9]+$").alias("bad_source"), F.count_if(~F.sha2("text", 256).rlike("^[0-9a-f]{64}$")).alias("bad_digest"), F.count_if(F.col("n_chars") != F.length("text")).alias("bad_length"), (F.count("*") - F.countDistinct("doc_id")).alias("repeated_ids"))


@query("SELECT l.doc_id, count(d.doc_id) AS n_found, CASE count(d.doc_id) WHEN 1 THEN 'resolved' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS outcome FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.source = 'src' || (l.doc_id % 20) GROUP BY l.doc_id")
def exact_lineage_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels resolved by a composite key, which must find exactly one row."""
    wanted = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("source"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(1).alias("hit"))
    n = F.count("hit")
    return wanted.join(docs, ["doc_id", "source"], "left").groupBy("doc_id").agg(n.alias("n_found"), F.when(n == 1, "resolved").when(n == 0, "missing").otherwise("ambiguous").alias("outcome"))


@query("WITH " + LEXICAL_SQL + "," + SEMANTIC_SQL + "SELECT s.item_id, s.doc_id, s.rank AS semantic_rank, coalesce(l.rank, 2147483647) AS lexical_rank FROM semantic s LEFT JOIN lexical l ON l.item_id = s.item_id AND l.doc_id = s.doc_id")
def semantic_with_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic hits with their lexical rank, the last of all where they have none."""
    ranks = lexical(spark, sf_dir).select("item_id", "doc_id", F.col("rank").alias("r"))
    return semantic(spark, sf_dir).join(ranks, ["item_id", "doc_id"], "left").select("item_id", "doc_id", F.col("rank").alias("semantic_rank"), F.coalesce("r", F.lit(2**31 - 1)).alias("lexical_rank"))


@query("SELECT user_id, count(*) FILTER (value > coalesce(before, -1e300)) AS n_peaks, round(max(value), 6) AS peak FROM (SELECT user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) GROUP BY user_id")
def running_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key's samples reach a new peak, and the peak."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    samples = table(spark, sf_dir, "events").select("user_id", "value", F.max("value").over(w).alias("before"))
    return samples.groupBy("user_id").agg(F.count_if(F.col("before").isNull() | (F.col("value") > F.col("before"))).alias("n_peaks"), F.round(F.max("value"), 6).alias("peak"))


@query("SELECT label, count(*) AS n_rows, min(len(embedding)) AS dimension, max(len(embedding)) = min(len(embedding)) AS uniform, sum(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: round(embedding[i]::DOUBLE * 1e6)::BIGINT * i)) * (vec_id % 1000 + 1))::BIGINT AS checksum FROM embeddings GROUP BY label")
def vector_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest row per label: rows, dimension and a checksum over all components that any order of rows gives."""
    v = table(spark, sf_dir, "embeddings")
    size = F.size("embedding").cast("long")
    weighed = F.transform("embedding", lambda x, i: F.round(x.cast("double") * 1e6).cast("long") * (i + 1))
    part = F.aggregate(weighed, F.lit(0).cast("long"), lambda acc, x: acc + x) * (F.col("vec_id") % 1000 + 1)
    return v.groupBy("label").agg(F.count("*").alias("n_rows"), F.min(size).alias("dimension"), (F.max(size) == F.min(size)).alias("uniform"), F.sum(part).alias("checksum"))


@query(
    "WITH "
    + LEXICAL_SQL
    + ","
    + SEMANTIC_SQL
    + """, c AS (SELECT item_id, doc_id, 'lexical' AS channel, rank AS position FROM lexical UNION ALL SELECT item_id, doc_id, 'semantic', rank + 50 FROM semantic)
    SELECT item_id, doc_id, channel, position, CASE WHEN position = min(position) OVER w THEN 'first' ELSE 'duplicate' END AS disposition, min(position) OVER w AS kept_position FROM c WINDOW w AS (PARTITION BY item_id, doc_id)"""
)
def candidate_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of both channels in one list: a repeated identity points at its first place."""
    a = lexical(spark, sf_dir).select("item_id", "doc_id", F.lit("lexical").alias("channel"), F.col("rank").alias("position"))
    b = semantic(spark, sf_dir).select("item_id", "doc_id", F.lit("semantic").alias("channel"), (F.col("rank") + 50).alias("position"))
    first = F.min("position").over(Window.partitionBy("item_id", "doc_id"))
    return a.unionByName(b).withColumn("kept_position", first).withColumn("disposition", F.when(F.col("position") == F.col("kept_position"), "first").otherwise("duplicate"))


@query(
    EVIDENCE_SQL
    + ","
    + SEMANTIC_SQL
    + """, first_ AS (SELECT doc_id, page_index, ordinal, start_offset, start_offset + length(chunk_text) AS end_offset FROM chunks_ QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_index, ordinal) = 1),
    r AS (SELECT item_id, doc_id, page_index, start_offset, end_offset, 'lexical' AS channel FROM evidence UNION ALL SELECT s.item_id, doc_id, f.page_index, f.start_offset, f.end_offset, 'semantic' FROM semantic s JOIN first_ f USING (doc_id))
    SELECT item_id, doc_id, page_index::INT AS page_index, start_offset::INT AS start_offset, end_offset::INT AS end_offset, string_agg(channel, '+' ORDER BY channel) AS provenance FROM r GROUP BY ALL"""
)
def coalesced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of both channels, of the best chunk by words and the first chunk by vectors: equal ones become one entry of both provenances."""
    place = ["item_id", "doc_id", "page_index", "start_offset", "end_offset"]
    by_words = _evidence(spark, sf_dir).select(*place, F.lit("lexical").alias("channel"))
    hits = cut(semantic(spark, sf_dir).select("item_id", "doc_id"))
    docs = table(spark, sf_dir, "documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    first = chunks(pages(docs)).groupBy("doc_id").agg(F.min(F.struct("page_index", "ordinal", "start_offset", "end_offset")).alias("c")).select("doc_id", "c.*")
    by_vector = hits.join(first, "doc_id").select(*place, F.lit("semantic").alias("channel"))
    both = by_words.union(by_vector).groupBy(*place).agg(F.array_join(F.sort_array(F.collect_set("channel")), "+").alias("provenance"))
    return both


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of positive longs: Euclid's steps as a fold; 64 halve any long away."""
    step = lambda acc, _: F.when(acc["y"] == 0, acc).otherwise(F.struct(acc["y"].alias("x"), (acc["x"] % acc["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.cast("long").alias("x"), b.cast("long").alias("y")), step)["x"]


@query(
    "WITH "
    + LEXICAL_SQL
    + ","
    + SEMANTIC_SQL
    + ","
    + FUSED_SQL
    + """, v AS (SELECT item_id, doc_id, fused_rank, score, CASE WHEN channels = 2 THEN (lexical_rank + semantic_rank + 80)::BIGINT ELSE 1 END AS a, coalesce(lexical_rank + 40, 1)::BIGINT * coalesce(semantic_rank + 40, 1) AS b FROM fused)
    SELECT item_id, doc_id, fused_rank, a // gcd(a, b) AS numerator, b // gcd(a, b) AS denominator, abs(score - a::DOUBLE / b) < 1e-15 AS agrees FROM v"""
)
def exact_fusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fused score as a reduced fraction, held against the score that ranked it."""
    one = lambda c: F.coalesce(F.col(c) + 40, F.lit(1)).cast("long")
    a = F.when(F.col("channels") == 2, F.col("lexical_rank") + F.col("semantic_rank") + 80).otherwise(1).cast("long")
    votes = fused(spark, sf_dir).select("item_id", "doc_id", "fused_rank", "score", a.alias("a"), (one("lexical_rank") * one("semantic_rank")).alias("b")).withColumn("g", gcd(F.col("a"), F.col("b")))
    return votes.select("item_id", "doc_id", "fused_rank", F.floor(F.col("a") / F.col("g")).alias("numerator"), F.floor(F.col("b") / F.col("g")).alias("denominator"), (F.abs(F.col("score") - F.col("a") / F.col("b")) < 1e-15).alias("agrees"))


@query(
    PACK_SQL
    + """, named AS (SELECT item_id, turn, 'E' || ((strlen(text) + k) % 12) AS label FROM (SELECT item_id, turn, text, unnest([0, 5, 12]) AS k FROM (SELECT DISTINCT item_id FROM packed) JOIN conversations ON conv_id = item_id WHERE role = 'assistant')),
    cited AS (SELECT item_id, turn, label, count(*) AS n_cited FROM named GROUP BY ALL)
    SELECT c.item_id, c.turn, c.label, c.n_cited, count(p.doc_id) AS n_entries, CASE WHEN c.n_cited > 1 THEN 'repeated' WHEN count(p.doc_id) = 1 THEN 'bound' ELSE 'unknown' END AS outcome, max(p.doc_id) AS doc_id FROM cited c LEFT JOIN packed p ON p.item_id = c.item_id AND p.label = c.label GROUP BY c.item_id, c.turn, c.label, c.n_cited"""
)
def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels cited by the turns of conversations, read strictly from their JSON: each must be cited once and name exactly one packed entry."""
    packed = cut(_packed(spark, sf_dir).filter("label IS NOT NULL").select("item_id", "label", "doc_id"))
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("item_id"), "turn", F.octet_length("text").alias("n"))
    label = lambda k: F.concat(F.lit("E"), ((F.col("n") + k) % 12).cast("string"))
    answers = turns.join(packed.select("item_id").distinct(), "item_id").select("item_id", "turn", F.to_json(F.struct(F.array(*map(label, (0, 5, 12))).alias("labels"))).alias("answer"))
    parsed = answers.select("item_id", "turn", F.from_json("answer", "labels array<string>", {"mode": "FAILFAST"}).alias("a"))
    cited = parsed.select("item_id", "turn", F.explode("a.labels").alias("label")).groupBy("item_id", "turn", "label").agg(F.count("*").alias("n_cited"))
    n = F.count("doc_id")
    bound = cited.join(packed, ["item_id", "label"], "left").groupBy("item_id", "turn", "label", "n_cited").agg(n.alias("n_entries"), F.max("doc_id").alias("doc_id"))
    return bound.withColumn("outcome", F.when(F.col("n_cited") > 1, "repeated").when(F.col("n_entries") == 1, "bound").otherwise("unknown"))


@query(
    "WITH "
    + LEXICAL_SQL
    + ","
    + SEMANTIC_SQL
    + ","
    + FUSED_SQL
    + f""", top_ AS (SELECT * FROM fused WHERE fused_rank <= 10), counts AS (SELECT item_id, max(lexical_rank) AS n_lexical, max(semantic_rank) AS n_semantic FROM fused GROUP BY item_id)
    SELECT t.item_id, count(*) AS n_hits, max(fused_rank) = count(*) AS contiguous, coalesce(any_value(n_lexical), 0)::INT AS n_lexical, coalesce(any_value(n_semantic), 0)::INT AS n_semantic, bool_and(coalesce(n_lexical, 0) <= 50 AND coalesce(n_semantic, 0) <= 50) AS within_caps, 0::BIGINT AS wrong_votes FROM top_ t JOIN counts USING (item_id) GROUP BY t.item_id"""
)
def envelope_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result envelopes verified anew: ranks from 1 on, channels within their depth, every vote recomputed as a fraction."""
    found = cut(fused(spark, sf_dir))
    counts = found.groupBy("item_id").agg(F.coalesce(F.max("lexical_rank"), F.lit(0)).alias("n_lexical"), F.coalesce(F.max("semantic_rank"), F.lit(0)).alias("n_semantic"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + 40), F.lit(0.0))
    wrong = F.abs(F.col("score") - (part("lexical_rank") + part("semantic_rank"))) > 1e-15
    over = (F.col("lexical_rank") > F.col("n_lexical")) | (F.col("semantic_rank") > F.col("n_semantic"))
    top = found.filter("fused_rank <= 10").join(counts, "item_id").groupBy("item_id", "n_lexical", "n_semantic").agg(F.count("*").alias("n_hits"), (F.max("fused_rank") == F.count("*")).alias("contiguous"), F.count_if(wrong | F.coalesce(over, F.lit(False))).alias("wrong_votes"))
    return top.withColumn("within_caps", (F.col("n_lexical") <= 50) & (F.col("n_semantic") <= 50))


@query("SELECT event_type, CASE WHEN len(r) = 0 THEN 'pass' ELSE 'fail' END AS status, array_to_string(r, ',') AS reasons FROM (SELECT event_type, list_filter([CASE WHEN quantile_cont(value, 0.95) > 40 THEN 'p95' END, CASE WHEN count(*) < 2000 THEN 'few_samples' END, CASE WHEN max(value) > 500 THEN 'worst' END], lambda x: x IS NOT NULL) AS r FROM events GROUP BY event_type)")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over measured values: a status and its reasons in fixed order."""
    events = table(spark, sf_dir, "events").select("event_type", "value")
    high = exact_percentiles(events, "event_type", "value", [0.95]).select("event_type", "percentile")
    measured = events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("worst")).join(high, "event_type", "left")
    gates = F.array_compact(F.array(F.when(F.col("percentile") > 40, F.lit("p95")), F.when(F.col("n") < 2000, F.lit("few_samples")), F.when(F.col("worst") > 500, F.lit("worst"))))
    return measured.select("event_type", gates.alias("r")).select("event_type", F.when(F.size("r") == 0, "pass").otherwise("fail").alias("status"), F.array_join("r", ",").alias("reasons"))


@query("SELECT item_id, n AS requested, least(100, greatest(50, 5 * n)) AS hybrid_depth, least(100, greatest(20, 5 * n)) AS branch_depth FROM (SELECT item_id, len(string_split(text, ' ')) % 30 + 1 AS n FROM benchmark)")
def depth_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep each channel is read for a requested number of hits."""
    n = (F.size(F.split("text", " ")) % 30 + 1).cast("long")
    capped = lambda low: F.least(F.lit(100), F.greatest(F.lit(low), 5 * n)).cast("long")
    return table(spark, sf_dir, "benchmark").select("item_id", n.alias("requested"), capped(50).alias("hybrid_depth"), capped(20).alias("branch_depth"))


@query(
    r"""WITH l AS (SELECT doc_id, y, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, y, list_filter(string_split(line, ' '), lambda v: v <> '') AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS y FROM documents)))
    SELECT doc_id, (y // 40)::INT AS page_index, count(DISTINCT y) AS n_lines, sha256(string_agg(w, ' ' ORDER BY y, pos)) AS text_sha256 FROM l GROUP BY ALL"""
)
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned words back in reading order: lines by vertical distance, words by horizontal place.

    Forty lines make a page. A line's words stand five points apart and up to two points off the line.
    """
    lines = F.transform(F.split("text", "\n"), lambda line, y: F.struct(F.floor(y / 40).cast("int").alias("page"), F.transform(F.array_remove(F.split(line, " "), ""), lambda w, p: F.struct((y * 12.0 + (p % 3) * 0.9).alias("top"), (p * 5.0).alias("x0"), w.alias("w"))).alias("words")))
    cut = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", lines.alias("lines"))
    numbers = F.sequence(F.lit(0), F.get("lines", F.size("lines") - 1)["page"])
    paged = cut.select("doc_id", F.explode(F.transform(numbers, lambda n: F.struct(n.alias("page_index"), F.flatten(F.transform(F.slice("lines", n * 40 + 1, 40), lambda x: x["words"])).alias("words")))).alias("x")).select("doc_id", "x.*")
    # Mixed by content first, so that nothing of the input's order is left.
    placed = paged.select("doc_id", "page_index", F.sort_array(F.transform("words", lambda w: F.struct(F.xxhash64(w["w"], w["x0"]).alias("h"), w.alias("p")))).alias("mixed"))
    ordered = placed.select("doc_id", "page_index", line_order(F.transform("mixed", lambda m: m["p"])).alias("lines")).filter(F.size("lines") > 0)
    text = F.array_join(F.flatten(F.transform("lines", lambda line: F.transform(line, lambda w: w["w"]))), " ")
    return ordered.select("doc_id", "page_index", F.size("lines").cast("long").alias("n_lines"), F.sha2(text, 256).alias("text_sha256"))

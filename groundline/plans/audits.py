"""Queries that audit: range, anti, semi and outer joins, coverage, counts, comparisons, timings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.operators.ingest import chunk_cuts, cut_pages, let, pages
from groundline.operators.ranking import exact_percentiles
from groundline.plans.ingest import CHUNKS_SQL
from groundline.plans.ranking import LEXICAL_SQL, lexical
from groundline.plans.registry import query
from groundline.sources.checkpoints import cut
from groundline.sources.tables import table

#: Anchors: every word of a page, where it stands in the page.
ANCHORS_SQL = """,
anchors AS (
  SELECT doc_id, page_index, i AS word_index, CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(page_words[1:i], ' ')) + 1 END AS a_start, page_words[i + 1] AS word
  FROM (SELECT doc_id, page_index, page_words, unnest(range(0, len(page_words))) AS i FROM pages_)
)
"""


def _per_chunk(spark: SparkSession, sf_dir: str, made: Callable[[Column, Column], Column]) -> DataFrame:
    """``doc_id, page_index`` and the fields of ``made(chunk, anchors)`` for each chunk, found in its page's row: no anchor leaves it."""
    cut_ = cut_pages(pages(table(spark, sf_dir, "documents")))
    anchors = F.zip_with("page_words", "starts", lambda w, at: F.struct(at.alias("a_start"), (at + F.length(w)).alias("a_end"), w.endswith(".").alias("ends")))
    numbered = let(anchors, lambda every: F.transform(every, lambda a, i: F.struct(i.alias("word_index"), a["a_start"].alias("a_start"), a["a_end"].alias("a_end"), a["ends"].alias("ends"))))
    each = let(numbered, lambda every: F.transform("chunks", lambda c: made(c, every)))
    return cut_.select("doc_id", "page_index", F.explode_outer(each).alias("m")).filter("m IS NOT NULL").select("doc_id", "page_index", "m.*")


def _overlapping(c: Column, a: Column) -> Column:
    return (a["a_start"] < c["end_offset"]) & (a["a_end"] > c["start_offset"])


@query(CHUNKS_SQL + ANCHORS_SQL + "SELECT c.doc_id, c.page_index::INT AS page_index, c.ordinal::INT AS ordinal, count(*) AS n_anchors, min(a.word_index)::INT AS first_word, max(a.word_index)::INT AS last_word FROM chunks_ c JOIN anchors a ON a.doc_id = c.doc_id AND a.page_index = c.page_index AND a.a_start < c.start_offset + length(c.chunk_text) AND a.a_start + length(a.word) > c.start_offset GROUP BY ALL")
def anchors_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that overlap each chunk: a range condition among the anchors of its page."""

    def met(c: Column, anchors: Column) -> Column:
        # Anchors are in order: none but the chunk's own and their neighbours can overlap it.
        near = F.slice(anchors, F.greatest(F.lit(1), c["start_word"]), c["n_words"] + 2)
        places = F.transform(F.filter(near, lambda a: _overlapping(c, a)), lambda a: a["word_index"])
        return let(places, lambda p: F.struct(c["ordinal"].alias("ordinal"), F.size(p).cast("long").alias("n_anchors"), F.array_min(p).alias("first_word"), F.array_max(p).alias("last_word")))

    return _per_chunk(spark, sf_dir, met).filter("n_anchors > 0")


@query(CHUNKS_SQL + ANCHORS_SQL + "SELECT c.doc_id, c.page_index::INT AS page_index, c.ordinal::INT AS ordinal, count(*) AS n_anchors FROM chunks_ c JOIN anchors a ON a.doc_id = c.doc_id AND a.page_index = c.page_index AND a.a_start >= c.start_offset AND a.a_start + length(a.word) <= c.start_offset + length(c.chunk_text) GROUP BY ALL")
def anchors_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that lie wholly within each chunk."""
    inside = lambda c, anchors: F.size(F.filter(anchors, lambda a: (a["a_start"] >= c["start_offset"]) & (a["a_end"] <= c["end_offset"])))
    return _per_chunk(spark, sf_dir, lambda c, anchors: F.struct(c["ordinal"].alias("ordinal"), inside(c, anchors).cast("long").alias("n_anchors"))).filter("n_anchors > 0")


@query(CHUNKS_SQL + ANCHORS_SQL + ", far AS (SELECT * FROM anchors WHERE word LIKE '%.') SELECT doc_id, page_index::INT AS page_index, ordinal::INT AS ordinal FROM chunks_ c WHERE NOT EXISTS (SELECT 1 FROM far a WHERE a.doc_id = c.doc_id AND a.page_index = c.page_index AND a.a_start < c.start_offset + length(c.chunk_text) AND a.a_start + length(a.word) > c.start_offset)")
def chunks_without_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in which no sentence ends: no such anchor overlaps them."""
    some = lambda c, anchors: F.exists(anchors, lambda a: a["ends"] & _overlapping(c, a))
    return _per_chunk(spark, sf_dir, lambda c, anchors: F.struct(c["ordinal"].alias("ordinal"), some(c, anchors).alias("some"))).filter("NOT some").drop("some")


@query(
    CHUNKS_SQL
    + ANCHORS_SQL
    + """, first_ AS (SELECT doc_id, page_index, min(a_start) AS begins, max(a_start + length(word)) AS ends FROM anchors WHERE word LIKE '%.' GROUP BY ALL),
    n AS (SELECT c.doc_id, c.page_index, c.ordinal, count(a.word) AS n FROM chunks_ c LEFT JOIN anchors a ON a.doc_id = c.doc_id AND a.page_index = c.page_index AND a.a_start BETWEEN c.start_offset AND c.start_offset + length(c.chunk_text) - 1 GROUP BY ALL)
    SELECT count(*) AS n_chunks, count(*) FILTER (n <> n_words) AS n_different, count(*) FILTER (f.begins IS NULL) AS n_without_end FROM chunks_ c JOIN n USING (doc_id, page_index, ordinal) LEFT JOIN first_ f USING (doc_id, page_index)"""
)
def anchor_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors mapped to chunks by a second way, words exploded and counted by the chunk in which they start, against the chunks' own counts."""
    cut_ = cut_pages(pages(table(spark, sf_dir, "documents")))
    each = cut_.select("doc_id", "page_index", "chunks", F.explode_outer(F.arrays_zip("starts", "page_words")).alias("a")).filter("a IS NOT NULL")
    home = F.filter("chunks", lambda c: (F.col("a.starts") >= c["start_offset"]) & (F.col("a.starts") < c["end_offset"]))[0]
    per_chunk = each.select("doc_id", "page_index", home.alias("c"), F.col("a.page_words").endswith(".").alias("ends")).groupBy("doc_id", "page_index", "c").agg(F.count("*").alias("n"), F.bool_or("ends").alias("ends"))
    per_page = per_chunk.groupBy("doc_id", "page_index").agg(F.count("*").alias("n"), F.count_if(F.col("n") != F.col("c.n_words")).alias("d"), F.bool_or("ends").alias("ends"))
    return per_page.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_different"), F.coalesce(F.sum(F.when(~F.col("ends"), F.col("n")).otherwise(0)), F.lit(0)).alias("n_without_end"))


@query(CHUNKS_SQL + ", bad AS (SELECT c.doc_id, c.page_index, c.ordinal FROM chunks_ c JOIN pages_ p ON p.doc_id = c.doc_id AND p.page_index = c.page_index WHERE c.chunk_text <> substring(array_to_string(p.page_words, ' '), c.start_offset + 1, length(c.chunk_text))) SELECT (SELECT count(*) FROM chunks_) AS n_chunks, (SELECT count(*) FROM bad) AS n_different, (SELECT count(*) FROM (SELECT doc_id, page_index, sum(n_words) AS s FROM chunks_ GROUP BY ALL) x JOIN pages_ p USING (doc_id, page_index) WHERE s <> len(page_words)) AS n_not_tiled")
def chunk_text_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose text is not their slice of the page, and pages whose chunks do not tile them: both must be none."""
    cut_ = cut_pages(pages(table(spark, sf_dir, "documents")))
    slice_ = lambda c: F.substring(F.col("page_text"), c["start_offset"] + 1, c["end_offset"] - c["start_offset"])
    words = lambda c: F.array_join(F.slice("page_words", c["start_word"] + 1, c["n_words"]), " ")
    different = F.size(F.filter("chunks", lambda c: slice_(c) != words(c)))
    tiled = F.aggregate("chunks", F.lit(0), lambda acc, c: acc + c["n_words"]) == F.size("page_words")
    counts = cut_.select(F.size("chunks").alias("n"), different.alias("d"), tiled.alias("tiled"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_different"), F.count_if(~F.col("tiled")).alias("n_not_tiled"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def unmapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a returned line (anti join)."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def active_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one segment's customers (semi join)."""
    customers = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey").join(customers, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS has_open FROM customer")
def has_chunks_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence as a column: customers with an open order."""
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(open_, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("has_open"))


@query(
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'label without document' WHEN l.doc_id IS NULL THEN 'document without label' WHEN d.lang IS DISTINCT FROM e.lang THEN 'language differs from earlier copy' END AS fault
    FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT text, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text) e ON e.text = d.text
    WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR d.lang IS DISTINCT FROM e.lang"""
)
def lineage_audit_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer-join audit with null-safe comparison: broken rows show up instead of vanishing."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "lang", F.sha2("text", 256).alias("h"))
    # Of the copies of a text, only those whose language is not the first one's go on; the group's rows are never joined.
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"))
    unlabelled = docs.select("d").join(labels, F.col("d") == F.col("l"), "full_outer").filter("d IS NULL OR l IS NULL")
    ends = unlabelled.select(F.coalesce("d", "l").alias("doc_id"), F.when(F.col("d").isNull(), "label without document").otherwise("document without label").alias("fault"))
    langs = docs.groupBy("h", "lang").agg(F.min("d").alias("first"))
    mixed = langs.groupBy("h").agg(F.min_by("lang", "first").alias("first_lang"), F.count("*").alias("n")).filter("n > 1 OR h IS NULL")
    known = labels.select(F.col("l").alias("d")).distinct()
    changed = docs.filter("h IS NOT NULL").join(mixed, "h").filter(~F.col("lang").eqNullSafe(F.col("first_lang"))).select("d").join(known, "d", "left_semi")
    wordless = docs.filter("h IS NULL AND lang IS NOT NULL").select("d").join(known, "d", "left_semi")
    return ends.union(changed.union(wordless).select("d", F.lit("language differs from earlier copy")))


@query(
    CHUNKS_SQL
    + """, c AS (SELECT doc_id, count(*) AS n_chunks FROM chunks_ GROUP BY doc_id), p AS (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (len(page_words) < 3 OR length(array_to_string(page_words, ' ')) < 24) AS n_needs_ocr FROM pages_ GROUP BY doc_id),
    s AS (SELECT source, doc_id, coalesce(n_chunks, 0) AS n_chunks, n_needs_ocr FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id))
    SELECT source, sum(('0x' || substring(sha256(doc_id || ':' || n_chunks || ':' || n_needs_ocr), 1, 12))::UBIGINT)::VARCHAR AS snapshot, sum(n_chunks)::BIGINT AS n_chunks, sum(n_needs_ocr)::BIGINT AS n_needs_ocr FROM s GROUP BY source"""
)
def source_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint per source of its documents' chunk and gap counts, each counted before they are joined.

    It is a sum of digests: no order is needed, and a large source is combined within tasks first.
    """
    docs = table(spark, sf_dir, "documents")
    # Pages come from one row each, so both counts are sums over one pass; one row of a document is left per task.
    gap = (F.size("page_words") < 3) | (F.length("page_text") < 24)
    counted = pages(docs).select("source", "doc_id", gap.cast("long").alias("gap"), F.when(gap, 0).otherwise(F.size(chunk_cuts(F.col("page_words")))).alias("cut"))
    s = counted.groupBy("source", "doc_id").agg(F.sum("cut").alias("n_chunks"), F.sum("gap").alias("n_needs_ocr"))
    digest = F.conv(F.substring(F.sha2(F.concat_ws(":", "doc_id", "n_chunks", "n_needs_ocr"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return s.groupBy("source").agg(F.sum(digest).cast("string").alias("snapshot"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_needs_ocr").alias("n_needs_ocr"))


@query(
    """WITH before AS (SELECT source, doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3), after AS (SELECT source, doc_id, CASE WHEN doc_id % 10 = 4 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 5)
    SELECT coalesce(b.source, a.source) AS source, count(*) FILTER (b.h IS NULL) AS n_added, count(*) FILTER (a.h IS NULL) AS n_removed, count(*) FILTER (a.h <> b.h) AS n_changed FROM before b FULL JOIN after a ON a.doc_id = b.doc_id GROUP BY 1"""
)
def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two states of each source, by a full outer join of their members."""
    docs = table(spark, sf_dir, "documents")
    last = F.col("doc_id") % 10
    before = docs.filter(last != 3).select("doc_id", F.col("source").alias("s1"), F.sha2("text", 256).alias("h1"))
    after = docs.filter(last != 5).select("doc_id", F.col("source").alias("s2"), F.sha2(F.when(last == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h2"))
    both = before.join(after, "doc_id", "full_outer").withColumn("source", F.coalesce("s1", "s2"))
    return both.groupBy("source").agg(F.count_if(F.col("h1").isNull()).alias("n_added"), F.count_if(F.col("h2").isNull()).alias("n_removed"), F.count_if(F.col("h1") != F.col("h2")).alias("n_changed"))


@query("SELECT label, count(*) AS n_rows, count(*) FILTER (vec_id % 9 <> 0) AS n_embeddable, coalesce(sum(CASE WHEN vec_id % 9 = 0 THEN 1 END), 0)::BIGINT AS n_excluded, count(DISTINCT vec_id // 4) AS n_parents FROM embeddings GROUP BY label")
def coverage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional and distinct counts of a vector build per label."""
    excluded = F.col("vec_id") % 9 == 0
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if(~excluded).alias("n_embeddable"), F.count_if(excluded).alias("n_excluded"), F.countDistinct(F.floor(F.col("vec_id") / 4)).alias("n_parents"))


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS n_distinct, min(vec_id) AS low, max(vec_id) AS high, min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AND count(DISTINCT vec_id) = count(*) AS contiguous FROM embeddings")
def contiguity_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether vector ids are exactly 0 to n - 1."""
    a = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("n_distinct"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))
    return a.withColumn("contiguous", F.expr("low = 0 AND high = n - 1 AND n_distinct = n"))


@query("SELECT sha256(text) AS text_sha256, count(*) AS n, count(DISTINCT lang) AS n_langs, max(doc_id) AS last_doc_id FROM documents GROUP BY text HAVING count(*) <> 1 OR max(lang) IS NULL")
def having_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are there more than once (grouping with a condition on the group)."""
    grouped = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_sha256"))
    return grouped.agg(F.count("*").alias("n"), F.countDistinct("lang").alias("n_langs"), F.max("doc_id").alias("last_doc_id"), F.max("lang").alias("some")).filter("n <> 1 OR some IS NULL").drop("some")


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS worst, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles with linear interpolation, per event type, without holding a type's values."""
    events = table(spark, sf_dir, "events").select("event_type", "value")
    v = F.col("value")
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max(v), 6).alias("worst"), F.round(F.avg(v), 6).alias("mean"))
    at = lambda p, name: F.round(F.max(F.when(F.col("part") == p, F.col("percentile"))), 6).alias(name)
    return counts.join(exact_percentiles(events, "event_type", "value", [0.5, 0.95]).groupBy("event_type").agg(at(0.5, "p50"), at(0.95, "p95")), "event_type", "left")


@query(
    """SELECT p.p_partkey, list_sort(list_filter([CASE WHEN p.p_brand IS DISTINCT FROM q.p_brand THEN 'p_brand' END, CASE WHEN p.p_size IS DISTINCT FROM q.p_size THEN 'p_size' END, CASE WHEN p.p_type IS DISTINCT FROM q.p_type THEN 'p_type' END], lambda x: x IS NOT NULL)) AS mismatches
    FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1"""
)
def record_field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which each part differs from the next one."""
    fields = ("p_brand", "p_size", "p_type")
    part = table(spark, sf_dir, "part")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), *(F.col(f).alias(f"next_{f}") for f in fields))
    diff = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"next_{f}")), F.lit(f)) for f in fields)))
    return part.join(following, "p_partkey").select("p_partkey", F.sort_array(diff).alias("mismatches"))


@query("""SELECT s_suppkey, sha256('{"name":"' || s_name || '","nation":' || s_nationkey || '}') AS sealed_sha256, length(s_name) > 0 AS sealed FROM supplier""")
def sealed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records sealed by the digest of their canonical JSON (fields in alphabetical order)."""
    body = F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.sha2(body, 256).alias("sealed_sha256"), (F.length("s_name") > 0).alias("sealed"))


@query("SELECT n_name, count(DISTINCT c_custkey) AS n_customers, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def fanout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts along two one-to-many joins; orders are summed per customer before they are joined."""
    per_customer = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(per_customer, "c_custkey", "left")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(customers, "n_nationkey", "left")
    return nations.groupBy("n_name").agg(F.count("c_custkey").alias("n_customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"), F.round(F.coalesce(F.sum("t"), F.lit(0.0)), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter below a grouped sum; the filter and the seven columns reach the scan."""
    lines = table(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(price), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query(
    "WITH "
    + LEXICAL_SQL
    + """, seq AS (SELECT 'whole' AS sequence, item_id, rank FROM lexical UNION ALL SELECT 'one source', item_id, rank FROM lexical JOIN documents d USING (doc_id) WHERE d.source = 'src3' UNION ALL SELECT 'twice', item_id, rank FROM lexical WHERE rank <= 5 UNION ALL SELECT 'twice', item_id, rank FROM lexical WHERE rank <= 3)
    SELECT sequence, item_id, count(*) AS n, count(*) FILTER (rank <> n) AS n_displaced, count(*) FILTER (rank = before) AS n_repeated, count(*) FILTER (rank <> n) = 0 AS contiguous, count(*) FILTER (rank = before) = 0 AS increasing
    FROM (SELECT *, row_number() OVER w AS n, lag(rank) OVER w AS before FROM seq WINDOW w AS (PARTITION BY sequence, item_id ORDER BY rank)) GROUP BY ALL"""
)
def rank_sequence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether rank sequences run 1 to n and rise: the lexical one, what a filter leaves of it, and one with repeats."""
    ranked = cut(lexical(spark, sf_dir).select("item_id", "doc_id", "rank"))
    one = ranked.join(table(spark, sf_dir, "documents").filter("source = 'src3'").select("doc_id"), "doc_id", "left_semi")
    parts = {"whole": ranked, "one source": one, "twice": ranked.filter("rank <= 5").union(ranked.filter("rank <= 3"))}
    rows = None
    for name, part in parts.items():
        each = part.select(F.lit(name).alias("sequence"), "item_id", "rank")
        rows = each if rows is None else rows.union(each)
    w = Window.partitionBy("sequence", "item_id").orderBy("rank")
    placed = rows.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("rank").over(w))
    counts = placed.groupBy("sequence", "item_id").agg(F.count("*").alias("n"), F.count_if(F.col("rank") != F.col("n")).alias("n_displaced"), F.count_if(F.col("rank") == F.col("before")).alias("n_repeated"))
    return counts.withColumn("contiguous", F.col("n_displaced") == 0).withColumn("increasing", F.col("n_repeated") == 0)


@query(
    """SELECT r.r_name AS customer_region, rs.r_name AS supplier_region, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n ON n.n_nationkey = c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
    JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ns ON ns.n_nationkey = s_nationkey JOIN region rs ON rs.r_regionkey = ns.n_regionkey WHERE p_size <= 25 GROUP BY ALL"""
)
def lineage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner joins of a line with its whole lineage over nine tables; the small ones are left to Spark to broadcast."""
    get = lambda name: table(spark, sf_dir, name)
    nations = get("nation").join(get("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyers = get("customer").join(nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("customer_region")), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "customer_region")
    sellers = get("supplier").join(nations.select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("supplier_region")), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "supplier_region")
    orders = get("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(buyers, "o_custkey")
    parts = get("part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    lines = get("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    joined = lines.join(parts, "l_partkey").join(sellers, "l_suppkey").join(orders, "l_orderkey")
    return joined.groupBy("customer_region", "supplier_region").agg(F.count("*").alias("n_lines"), F.round(F.sum("price"), 2).alias("revenue"))


@query(
    """SELECT fault, count(*) AS n FROM (SELECT CASE WHEN o_orderkey IS NULL THEN 'no order' WHEN c_custkey IS NULL THEN 'no customer' WHEN p_partkey IS NULL THEN 'no part' WHEN s_suppkey IS NULL THEN 'no supplier' WHEN n.n_nationkey IS NULL OR ns.n_nationkey IS NULL THEN 'no nation' WHEN r.r_name IS NULL OR rs.r_name IS NULL THEN 'no region'
      WHEN r.r_name IS DISTINCT FROM rs.r_name THEN 'regions differ' END AS fault
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P' LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING' LEFT JOIN nation n ON n.n_nationkey = c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
    LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 45 LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ns ON ns.n_nationkey = s_nationkey LEFT JOIN region rs ON rs.r_regionkey = ns.n_regionkey) WHERE fault IS NOT NULL GROUP BY fault"""
)
def lineage_chain_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lineage by outer joins: a broken link shows up as the first fault of its line instead of vanishing."""
    get = lambda name: table(spark, sf_dir, name)
    nations = get("nation").join(get("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "r_name")

    def placed(rows: DataFrame, key: str, prefix: str) -> DataFrame:
        return rows.join(nations.select(F.col("n_nationkey").alias(key), F.col("r_name").alias(f"{prefix}_region"), F.lit(True).alias(f"{prefix}_nation")), key, "left").drop(key)

    buyers = placed(get("customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.lit(True).alias("customer")), "c_nationkey", "c")
    sellers = placed(get("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", F.lit(True).alias("supplier")), "s_nationkey", "s")
    orders = get("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.lit(True).alias("ordered")).join(buyers, "o_custkey", "left")
    parts = get("part").filter("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("part"))
    lines = get("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(parts, "l_partkey", "left").join(sellers, "l_suppkey", "left").join(orders, "l_orderkey", "left")
    none = lambda *names: F.expr(" OR ".join(f"{n} IS NULL" for n in names))
    fault = F.when(none("ordered"), "no order").when(none("customer"), "no customer").when(none("part"), "no part").when(none("supplier"), "no supplier")
    fault = fault.when(none("c_nation", "s_nation"), "no nation").when(none("c_region", "s_region"), "no region").when(~F.col("c_region").eqNullSafe(F.col("s_region")), "regions differ")
    return lines.select(fault.alias("fault")).filter("fault IS NOT NULL").groupBy("fault").agg(F.count("*").alias("n"))

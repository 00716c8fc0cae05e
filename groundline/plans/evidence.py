"""Queries of evidence handling: references, resolution, packing, groups, verification, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.functions.text import TOKEN, query_terms
from groundline.operators.evidence import POLICY, best_chunks, bundle_state, entry_json, pack, resolution_code, sealed, verify_proposals
from groundline.operators.ingest import chunks, pages
from groundline.plans.ingest import CHUNKS_SQL, PAGES_SQL, identified
from groundline.plans.ranking import LEXICAL_SQL, TOP, lexical
from groundline.plans.registry import query
from groundline.sources.checkpoints import cut
from groundline.sources.tables import table

MAX_BYTES, MAX_ENTRIES = 4000, 8

#: The chunk of each hit that holds the most of the search's terms.
EVIDENCE_SQL = (
    CHUNKS_SQL
    + ","
    + LEXICAL_SQL
    + f""", qt AS (SELECT item_id, list(term) AS terms FROM q GROUP BY item_id),
met AS (SELECT l.item_id, l.doc_id, l.rank, c.page_index, c.ordinal, c.n_words, c.start_offset, c.start_offset + length(c.chunk_text) AS end_offset, c.chunk_text,
  row_number() OVER (PARTITION BY l.item_id, l.doc_id ORDER BY len(list_intersect(regexp_extract_all(lower(c.chunk_text), '{TOKEN}'), terms)) DESC, c.page_index, c.ordinal) AS place FROM lexical l JOIN chunks_ c USING (doc_id) JOIN qt USING (item_id)),
evidence AS (SELECT item_id, doc_id, rank, page_index::INT AS page_index, ordinal::INT AS ordinal, n_words::INT AS n_words, start_offset::INT AS start_offset, end_offset::INT AS end_offset, chunk_text FROM met WHERE place = 1)
"""
)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the place and the whole text of the chunk that matches best; only hit documents are cut into chunks."""
    hits = cut(lexical(spark, sf_dir).select("item_id", "doc_id", "rank"))
    docs = table(spark, sf_dir, "documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    terms = table(spark, sf_dir, "benchmark").select("item_id", query_terms(F.col("text")).alias("terms"))
    chunk_rows = chunks(pages(docs)).select("doc_id", "page_index", "ordinal", "n_words", "start_offset", "end_offset", "chunk_text")
    return best_chunks(hits, chunk_rows, terms, "item_id")


#: References with planted faults, one kind for each remainder, so that every check has something to find.
_FAULTS = {"doc": 13, "far": 11, "digest": 7, "page": 17, "scope": 19, "anchors": 23, "negative": 29, "long": 31, "order": 37, "other": 41, "same": 43}
REFS_SQL = f"""refs AS (SELECT item_id, CASE WHEN doc_id % 13 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 37 = 0 THEN rank + 1000 ELSE rank END AS rank, rank AS position,
  CASE WHEN doc_id % 19 = 0 THEN 'elsewhere' ELSE d.source END AS source, page_index + CASE WHEN doc_id % 17 = 0 THEN 100000 ELSE 0 END AS page_index,
  CASE WHEN doc_id % 29 = 0 THEN -1 WHEN doc_id % 11 = 0 THEN start_offset + 5000000 ELSE start_offset END AS start_offset, CASE WHEN doc_id % 31 = 0 THEN end_offset + 9000000 WHEN doc_id % 11 = 0 THEN end_offset + 5000000 ELSE end_offset END AS end_offset,
  sha256(chunk_text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS digest, n_words + CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END AS n_anchors FROM evidence JOIN documents d USING (doc_id))"""
#: Bundles that name a reference once more at their end, with another digest or as it is.
TWICE_SQL = """, named AS (SELECT * FROM refs UNION ALL SELECT item_id, doc_id, rank + 10000, position + 10000, source, page_index, start_offset, end_offset, CASE WHEN doc_id % 41 = 0 THEN sha256(digest) ELSE digest END, n_anchors FROM refs WHERE doc_id % 41 = 0 OR doc_id % 43 = 0)"""


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to the evidence of each hit: where it stands, its digest and the number of its words, without its text."""
    fault = lambda kind: F.col("doc_id") % _FAULTS[kind] == 0
    sources = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("true_source"))
    e = _evidence(spark, sf_dir).join(sources, "doc_id")
    return e.select(
        "item_id",
        (F.col("doc_id") + F.when(fault("doc"), 1_000_000_000).otherwise(0)).alias("doc_id"),
        (F.col("rank") + F.when(fault("order"), 1000).otherwise(0)).alias("rank"),
        F.col("rank").alias("position"),
        F.when(fault("scope"), "elsewhere").otherwise(F.col("true_source")).alias("source"),
        (F.col("page_index") + F.when(fault("page"), 100_000).otherwise(0)).alias("page_index"),
        F.when(fault("negative"), -1).otherwise(F.col("start_offset") + F.when(fault("far"), 5_000_000).otherwise(0)).alias("start_offset"),
        (F.col("end_offset") + F.when(fault("long"), 9_000_000).when(fault("far"), 5_000_000).otherwise(0)).alias("end_offset"),
        F.sha2(F.concat("chunk_text", F.when(fault("digest"), "!").otherwise("")), 256).alias("digest"),
        (F.col("n_words") + fault("anchors").cast("int")).alias("n_anchors"),
    )


def _named(refs: DataFrame) -> DataFrame:
    """References of bundles some of which name one once more at their end: with another digest, or as it is."""
    other, same = F.col("doc_id") % _FAULTS["other"] == 0, F.col("doc_id") % _FAULTS["same"] == 0
    again = refs.filter(other | same).withColumn("digest", F.when(other, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return refs.unionByName(again.withColumn("rank", F.col("rank") + 10_000).withColumn("position", F.col("position") + 10_000))


def contradictions(refs: DataFrame, bundle: str, identity: list[str], facts: list[str]) -> DataFrame:
    """``bundle, identity`` of references that a bundle names with different facts; the same facts again are no fault."""
    same = F.lit(True)
    for c in facts:
        same = same & F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count("*")))
    return refs.groupBy(bundle, *identity).agg((~same).alias("contradicted")).filter("contradicted")


@query(EVIDENCE_SQL + "," + REFS_SQL + "SELECT item_id, doc_id, rank, source, page_index::INT AS page_index, start_offset::INT AS start_offset, end_offset::INT AS end_offset, digest, n_anchors::INT AS n_anchors FROM refs")
def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as references to their best chunk: page, range, digest and number of anchors, without text."""
    return _references(spark, sf_dir).drop("position")


@query(
    EVIDENCE_SQL
    + ","
    + REFS_SQL
    + TWICE_SQL
    + """, latest AS (SELECT sha256(text) AS h, max(doc_id) AS newest FROM documents WHERE text IS NOT NULL GROUP BY text),
    withdrawn AS (SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) = 'error'),
    facts AS (SELECT item_id, doc_id, page_index, start_offset, end_offset, count(DISTINCT (digest, n_anchors, source)) > 1 AS contradicted FROM named GROUP BY ALL),
    asked AS (SELECT *, rank <= max(rank) OVER (PARTITION BY item_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS disordered FROM named JOIN facts USING (item_id, doc_id, page_index, start_offset, end_offset))
    SELECT r.item_id, r.doc_id, r.rank, CASE WHEN r.start_offset < 0 OR r.end_offset <= r.start_offset THEN 'INVALID_REQUEST' WHEN r.end_offset - r.start_offset > 4194304 THEN 'RESOURCE_LIMIT' WHEN d.doc_id IS NULL THEN 'SOURCE_NOT_FOUND'
      WHEN r.source IS DISTINCT FROM d.source THEN 'SOURCE_SCOPE_MISMATCH' WHEN l.newest <> d.doc_id THEN 'GENERATION_NOT_CURRENT' WHEN p.doc_id IS NULL THEN 'REFERENCE_NOT_FOUND' WHEN r.end_offset > length(p.t) THEN 'RANGE_MISMATCH'
      WHEN sha256(p.t[r.start_offset + 1 : r.end_offset]) <> r.digest THEN 'TEXT_DIGEST_MISMATCH' WHEN len(string_split(p.t[r.start_offset + 1 : r.end_offset], ' ')) <> r.n_anchors THEN 'ANCHOR_MISMATCH'
      WHEN e.vec_id IS NULL THEN 'VECTOR_UNAVAILABLE' WHEN w.user_id IS NOT NULL THEN 'VECTOR_NOT_CURRENT' WHEN abs(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) - 1) > 1e-5 THEN 'VECTOR_INTEGRITY' WHEN r.disordered THEN 'INVALID_ORDER' WHEN r.contradicted THEN 'CONTRADICTORY_DUPLICATE' ELSE 'ok' END AS code
    FROM asked r LEFT JOIN documents d ON d.doc_id = r.doc_id LEFT JOIN latest l ON l.h = sha256(d.text) LEFT JOIN (SELECT doc_id, page_index, array_to_string(page_words, ' ') AS t FROM pages_) p ON p.doc_id = r.doc_id AND p.page_index = r.page_index LEFT JOIN embeddings e ON e.vec_id = r.doc_id LEFT JOIN withdrawn w ON w.user_id = r.doc_id"""
)
def evidence_resolve_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that each reference fails against the documents; a text's newest copy is the current one.

    Only referenced documents are read out; of all others, just the digests of
    the same texts are looked at. A vector is current unless the last entry of
    its key in the log of ``events`` withdraws it. A reference that its bundle
    names with other facts, too, is a contradictory duplicate.
    """
    refs = cut(_named(_references(spark, sf_dir)))
    identity = ["doc_id", "page_index", "start_offset", "end_offset"]
    refs = refs.join(contradictions(refs, "item_id", identity, ["digest", "n_anchors", "source"]), ["item_id", *identity], "left")
    before = Window.partitionBy("item_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    refs = refs.withColumn("disordered", F.col("rank") <= F.max("rank").over(before))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    asked = docs.join(refs.select("doc_id").distinct(), "doc_id", "left_semi")
    digests = cut(asked.select("doc_id", F.col("source").alias("true_source"), F.sha2("text", 256).alias("h")))
    copies = docs.select("doc_id", F.sha2("text", 256).alias("h")).join(digests.select("h").distinct(), "h", "left_semi")
    newest = copies.groupBy("h").agg(F.max("doc_id").alias("newest"))
    known = digests.join(newest, "h", "left").select("doc_id", "true_source", (F.col("newest") == F.col("doc_id")).alias("current"), F.lit(True).alias("found"))
    page_rows = pages(asked).select("doc_id", "page_index", "page_text")
    norms = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))).alias("norm"))
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    withdrawn = last.filter("last = 'error'").join(refs.select("doc_id").distinct(), "doc_id", "left_semi")
    joined = refs.join(withdrawn, "doc_id", "left").join(known, "doc_id", "left").join(page_rows, ["doc_id", "page_index"], "left").join(norms, "doc_id", "left")
    piece = F.substring(F.col("page_text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    code = resolution_code(
        {
            "INVALID_REQUEST": (F.col("start_offset") < 0) | (F.col("end_offset") <= F.col("start_offset")),
            "RESOURCE_LIMIT": F.col("end_offset") - F.col("start_offset") > 4_194_304,
            "SOURCE_NOT_FOUND": F.col("found").isNull(),
            "SOURCE_SCOPE_MISMATCH": ~F.col("source").eqNullSafe(F.col("true_source")),
            "GENERATION_NOT_CURRENT": ~F.col("current"),
            "REFERENCE_NOT_FOUND": F.col("page_text").isNull(),
            "RANGE_MISMATCH": F.col("end_offset") > F.length("page_text"),
            "TEXT_DIGEST_MISMATCH": F.sha2(piece, 256) != F.col("digest"),
            "ANCHOR_MISMATCH": F.size(F.split(piece, " ")) != F.col("n_anchors"),
            "VECTOR_UNAVAILABLE": F.col("norm").isNull(),
            "VECTOR_NOT_CURRENT": F.col("last").isNotNull(),
            "VECTOR_INTEGRITY": F.abs(F.col("norm") - 1) > 1e-5,
            "INVALID_ORDER": F.col("disordered"),
            "CONTRADICTORY_DUPLICATE": F.col("contradicted"),
        }
    )
    return joined.select("item_id", "doc_id", "rank", code.alias("code"))


@query(
    "WITH "
    + PAGES_SQL.rstrip().rstrip(",")
    + """, f AS (SELECT doc_id, page_index, CASE WHEN length(t) = 0 THEN 'empty' WHEN n < 3 OR length(t) < 24 THEN 'low' ELSE 'adequate' END AS q FROM (SELECT doc_id, page_index, len(page_words) AS n, array_to_string(page_words, ' ') AS t FROM pages_))
    SELECT doc_id, CASE WHEN bool_or(q = 'low') THEN 'known_gaps' WHEN bool_or(q = 'empty') THEN 'unknown' ELSE 'none' END AS coverage, count(*) AS n_pages, count(*) FILTER (q <> 'adequate') AS n_flagged FROM f GROUP BY doc_id"""
)
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each document: known gaps before unknown before none."""
    length = F.length("page_text")
    q = pages(table(spark, sf_dir, "documents")).select("doc_id", (length == 0).alias("empty"), ((length > 0) & ((F.size("page_words") < 3) | (length < 24))).alias("low"))
    status = F.when(F.bool_or("low"), "known_gaps").when(F.bool_or("empty"), "unknown").otherwise("none")
    return q.groupBy("doc_id").agg(status.alias("coverage"), F.count("*").alias("n_pages"), F.count_if(F.col("low") | F.col("empty")).alias("n_flagged"))


def _entry(doc: str, label: str, text: str) -> str:
    return f"to_json({{'doc': {doc}, 'label': {label}, 'text': {text}}})::VARCHAR"


def pack_sql(units: str, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES) -> str:
    """CTEs that pack ``units`` (item_id, unit 1, 2, ..., docs, ranks, texts: lists of one or two) by a recursion: ``packed``."""
    size = lambda i: f"strlen({_entry(f'u.docs[{i}]', f"'E' || (f.n + {i})", f'u.texts[{i}]')})"
    return f"""units AS ({units}), fold AS (
      SELECT item_id, 0::BIGINT AS unit, NULL::BIGINT[] AS docs, NULL::INT[] AS ranks, 77::BIGINT AS used, 0::BIGINT AS n, 0::BIGINT AS before, NULL::VARCHAR AS disposition FROM (SELECT DISTINCT item_id FROM units)
      UNION ALL
      SELECT item_id, unit, docs, ranks, used + CASE WHEN fits THEN size ELSE 0 END, n + CASE WHEN fits THEN len(docs) ELSE 0 END, n, CASE WHEN crowded THEN 'entry_limit' WHEN fits THEN 'packed' ELSE 'byte_limit' END
      FROM (SELECT *, NOT crowded AND used + size <= {max_bytes} AS fits FROM (SELECT u.item_id, u.unit, u.docs, u.ranks, f.used, f.n, f.n + len(u.docs) > {max_entries} AS crowded,
        {size(1)} + CASE WHEN f.n > 0 THEN 1 ELSE 0 END + CASE WHEN len(u.docs) > 1 THEN {size(2)} + 1 ELSE 0 END AS size FROM fold f JOIN units u ON u.item_id = f.item_id AND u.unit = f.unit + 1))),
    packed AS (SELECT item_id, docs[i] AS doc_id, ranks[i] AS rank, CASE WHEN disposition = 'packed' THEN 'E' || (before + i) END AS label, disposition, unit FROM (SELECT *, unnest(range(1, len(docs) + 1)) AS i FROM fold WHERE unit > 0))
    """


SINGLE_SQL = "SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS unit, [doc_id] AS docs, [rank] AS ranks, [chunk_text] AS texts FROM evidence"
PACK_SQL = EVIDENCE_SQL + ", " + pack_sql(SINGLE_SQL)
BODY_SQL = f""", bodies AS (SELECT p.item_id, '{{"evidence":[' || string_agg({_entry("p.doc_id", "p.label", "e.chunk_text")}, ',' ORDER BY p.rank) || ']}}' AS body FROM packed p JOIN evidence e ON e.item_id = p.item_id AND e.doc_id = p.doc_id WHERE p.label IS NOT NULL GROUP BY p.item_id)
"""


def _packed(spark: SparkSession, sf_dir: str, evidence: DataFrame | None = None) -> DataFrame:
    evidence = _evidence(spark, sf_dir) if evidence is None else evidence
    candidates = evidence.select("item_id", "rank", "doc_id", F.col("chunk_text").alias("text"))
    return pack(candidates, "item_id", max_bytes=MAX_BYTES, max_entries=MAX_ENTRIES)


def _bodies(packed: DataFrame, evidence: DataFrame) -> DataFrame:
    """``item_id, body``: the packed entries as canonical JSON; a bundle has a few entries."""
    texts = evidence.select("item_id", "doc_id", F.col("chunk_text").alias("text"))
    entries = packed.filter("label IS NOT NULL").join(texts, ["item_id", "doc_id"]).select("item_id", "rank", entry_json(F.col("label"), F.col("doc_id"), F.col("text")).alias("e"))
    rows = entries.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "e"))).alias("x"))
    return rows.select("item_id", F.concat(F.lit('{"evidence":['), F.array_join(F.transform("x", lambda r: r["e"]), ","), F.lit("]}")).alias("body"))


@query(PACK_SQL + "SELECT item_id, doc_id, rank::INT AS rank, label, disposition FROM packed")
def evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chunks packed in rank order under a byte and an entry budget; what does not fit is passed over."""
    return _packed(spark, sf_dir)


@query(PACK_SQL + "SELECT item_id, count(label) AS n_packed, count(*) AS n_candidates, CASE WHEN count(label) = 0 THEN 'budget_too_small' WHEN count(label) < count(*) THEN 'partial' ELSE 'ready' END AS state FROM packed GROUP BY item_id")
def evidence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each bundle."""
    counts = _packed(spark, sf_dir).groupBy("item_id").agg(F.count("label").alias("n_packed"), F.count("*").alias("n_candidates"))
    return counts.withColumn("state", bundle_state(F.col("n_packed"), F.col("n_candidates")))


@query(PACK_SQL + BODY_SQL + "SELECT item_id, strlen(body) AS n_bytes, sha256(body) AS fingerprint, true AS same_again, CASE WHEN (SELECT count(*) FROM packed p WHERE p.item_id = b.item_id AND label IS NULL) > 0 THEN 'partial' ELSE 'ready' END AS outcome FROM bodies b")
def evidence_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles built and sealed twice, the second time from candidates in another order: equal bytes or ``failed``."""
    evidence = cut(_evidence(spark, sf_dir))
    first = cut(_packed(spark, sf_dir, evidence))
    again = _packed(spark, sf_dir, evidence.orderBy(F.xxhash64("doc_id", "item_id")))
    one = _bodies(first, evidence).select("item_id", F.octet_length("body").cast("long").alias("n_bytes"), sealed(F.col("body")).alias("fingerprint"))
    two = _bodies(again, evidence).select("item_id", sealed(F.col("body")).alias("other"))
    left_out = first.groupBy("item_id").agg(F.count_if(F.col("label").isNull()).alias("n_left"))
    both = one.join(two, "item_id", "left").join(left_out, "item_id").withColumn("same_again", F.col("fingerprint").eqNullSafe(F.col("other")))
    outcome = F.when(~F.col("same_again") | F.col("fingerprint").isNull(), "failed").when(F.col("n_left") > 0, "partial").otherwise("ready")
    return both.select("item_id", "n_bytes", "fingerprint", "same_again", outcome.alias("outcome"))


#: Neighbouring hits in pairs: both of one source and not overlapping make a group, others stand alone.
GROUPS_SQL = """, near AS (SELECT e.*, d.source, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS i FROM evidence e JOIN documents d USING (doc_id)),
pairs AS (SELECT a.item_id, a.i, a.doc_id AS a_doc, b.doc_id AS b_doc, a.rank AS a_rank, b.rank AS b_rank, a.chunk_text AS a_text, b.chunk_text AS b_text,
  CASE WHEN b.doc_id IS NULL THEN 'alone' WHEN a.source IS DISTINCT FROM b.source THEN 'other_lineage' WHEN a.doc_id = b.doc_id AND a.page_index = b.page_index AND greatest(a.start_offset, b.start_offset) < least(a.end_offset, b.end_offset) THEN 'overlap' ELSE 'group' END AS kind,
  sha256('pair-v1:' || (CASE WHEN a.doc_id <= b.doc_id THEN a.doc_id || ':' || a.page_index || ':' || a.start_offset || ',' || b.doc_id || ':' || b.page_index || ':' || b.start_offset ELSE b.doc_id || ':' || b.page_index || ':' || b.start_offset || ',' || a.doc_id || ':' || a.page_index || ':' || a.start_offset END)) AS group_id
  FROM near a LEFT JOIN near b ON b.item_id = a.item_id AND b.i = a.i + 1 WHERE a.i % 2 = 1)
"""
_UNITS_SQL = """SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY first) AS unit, docs, ranks, texts FROM (
  SELECT item_id, a_rank AS first, [a_doc, b_doc] AS docs, [a_rank, b_rank] AS ranks, [a_text, b_text] AS texts FROM pairs WHERE kind = 'group'
  UNION ALL SELECT item_id, a_rank, [a_doc], [a_rank], [a_text] FROM pairs WHERE kind <> 'group'
  UNION ALL SELECT item_id, b_rank, [b_doc], [b_rank], [b_text] FROM pairs WHERE kind IN ('other_lineage', 'overlap'))"""


def _pairs(spark: SparkSession, sf_dir: str, evidence: DataFrame) -> DataFrame:
    """Neighbours by rank in pairs, with ``kind`` and, for groups, an identity that their order does not change."""
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("rank"))
    near = evidence.join(sources, "doc_id").withColumn("pair", F.floor((place - 1) / 2))
    facts = F.struct("rank", "doc_id", "page_index", "start_offset", "end_offset", "source")
    two = near.groupBy("item_id", "pair").agg(F.min(facts).alias("a"), F.max(facts).alias("b"), F.count("*").alias("n"))
    overlap = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_index") == F.col("b.page_index")) & (F.greatest("a.start_offset", "b.start_offset") < F.least("a.end_offset", "b.end_offset"))
    kind = F.when(F.col("n") == 1, "alone").when(~F.col("a.source").eqNullSafe(F.col("b.source")), "other_lineage").when(overlap, "overlap").otherwise("group")
    name = lambda x: F.concat_ws(":", f"{x}.doc_id", f"{x}.page_index", f"{x}.start_offset")
    ids = F.when(F.col("a.doc_id") <= F.col("b.doc_id"), F.concat(name("a"), F.lit(","), name("b"))).otherwise(F.concat(name("b"), F.lit(","), name("a")))
    return two.withColumn("kind", kind).withColumn("group_id", F.sha2(F.concat(F.lit("pair-v1:"), ids), 256))


@query(EVIDENCE_SQL + GROUPS_SQL + "SELECT item_id, a_doc AS first_doc_id, b_doc AS second_doc_id, kind, CASE WHEN kind = 'group' THEN group_id END AS group_id FROM pairs WHERE kind <> 'alone'")
def evidence_groups_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring hits in groups of two: one lineage, no overlap, an identity that their order does not change."""
    pairs = _pairs(spark, sf_dir, _evidence(spark, sf_dir)).filter("kind <> 'alone'")
    return pairs.select("item_id", F.col("a.doc_id").alias("first_doc_id"), F.col("b.doc_id").alias("second_doc_id"), "kind", F.when(F.col("kind") == "group", F.col("group_id")).alias("group_id"))


def _group_units(spark: SparkSession, sf_dir: str, evidence: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, unit, text``: the members of groups under one unit, other hits under their own."""
    pairs = _pairs(spark, sf_dir, evidence)
    members = pairs.select("item_id", F.explode(F.when(F.col("kind") == "group", F.array(*(F.struct(F.col(f"{x}.doc_id").alias("doc_id"), F.col("a.rank").alias("unit")) for x in "ab"))).otherwise(F.array_distinct(F.array(*(F.struct(F.col(f"{x}.doc_id").alias("doc_id"), F.col(f"{x}.rank").alias("unit")) for x in "ab"))))).alias("m"))
    return evidence.join(members.select("item_id", "m.*"), ["item_id", "doc_id"]).select("item_id", "rank", "doc_id", "unit", F.col("chunk_text").alias("text"))


@query(EVIDENCE_SQL + GROUPS_SQL + "," + pack_sql(_UNITS_SQL) + "SELECT item_id, doc_id, rank::INT AS rank, label, disposition FROM packed")
def evidence_group_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups packed as units, both entries or none, between hits that stand alone."""
    return pack(_group_units(spark, sf_dir, cut(_evidence(spark, sf_dir))), "item_id", max_bytes=MAX_BYTES, max_entries=MAX_ENTRIES, unit="unit")


#: What each search proposes by the remainder of its id: values and citations, some of which break a rule.
_PROPOSED = """props AS (SELECT b.item_id, CASE WHEN b.item_id % 10 = 4 THEN 'other-policy' ELSE 'exact-source-text-v1' END AS policy, CASE WHEN b.item_id % 10 = 5 THEN sha256(f.fingerprint) ELSE f.fingerprint END AS fingerprint,
  CASE b.item_id % 10 WHEN 1 THEN f.text || ' ' WHEN 7 THEN repeat(f.text, 40) ELSE f.text END AS value,
  CASE b.item_id % 10 WHEN 2 THEN ['E1', 'E99'] WHEN 3 THEN ['E1', 'E1'] WHEN 6 THEN [] WHEN 8 THEN [f.last] WHEN 9 THEN ['E1', 'E2', 'E3'] ELSE f.unit_labels END AS labels FROM benchmark b JOIN firsts f USING (item_id))"""


@query(
    EVIDENCE_SQL
    + GROUPS_SQL
    + ","
    + pack_sql(_UNITS_SQL)
    + """, es AS (SELECT p.item_id, p.label, p.unit, p.doc_id, e.chunk_text AS text, p.rank, count(*) OVER (PARTITION BY p.item_id, p.unit) AS unit_size FROM packed p JOIN evidence e ON e.item_id = p.item_id AND e.doc_id = p.doc_id JOIN documents d ON d.doc_id = p.doc_id WHERE p.label IS NOT NULL),
    newest AS (SELECT text AS t, max(doc_id) AS newest FROM documents GROUP BY text),
    ec AS (SELECT es.*, n.newest = es.doc_id AS is_current FROM es JOIN documents d ON d.doc_id = es.doc_id JOIN newest n ON n.t = d.text),
    firsts AS (SELECT item_id, sha256(string_agg(label || ':' || doc_id, ',' ORDER BY rank)) AS fingerprint, arg_min(text, rank) AS text, arg_max(label, rank) AS last, list(label ORDER BY rank) FILTER (unit = 1) AS unit_labels FROM ec GROUP BY item_id),
    """
    + _PROPOSED
    + """, cited AS (SELECT p.item_id, p.value, c.label, ec.unit, ec.unit_size, ec.text, ec.is_current FROM (SELECT item_id, value, unnest(list_distinct(labels)) AS label FROM props) c JOIN props p USING (item_id) LEFT JOIN ec ON ec.item_id = c.item_id AND ec.label = c.label),
    u AS (SELECT item_id, unit, any_value(unit_size) AS unit_size, count(*) AS n, count(*) FILTER (text IS NULL) AS unknown, count(*) FILTER (NOT is_current) AS stale, bool_and(value = text) AS exact FROM cited GROUP BY item_id, unit),
    f AS (SELECT item_id, sum(unknown) AS unknown, bool_or(n < unit_size) AS incomplete, sum(stale) AS stale, max(unit_size) AS largest, bool_and(exact) AS exact FROM u GROUP BY item_id),
    coded AS (SELECT p.item_id, CASE WHEN len(p.labels) = 0 OR trim(p.value) = '' THEN 'INVALID_REQUEST' WHEN p.policy <> 'exact-source-text-v1' THEN 'POLICY_MISMATCH' WHEN strlen(p.value) > 2000 THEN 'RESOURCE_LIMIT'
      WHEN p.fingerprint <> firsts.fingerprint OR len(list_distinct(p.labels)) < len(p.labels) OR f.unknown > 0 THEN 'EVIDENCE_REFERENCE_INVALID' WHEN f.incomplete THEN 'EVIDENCE_GROUP_INCOMPLETE' WHEN f.stale > 0 THEN 'SOURCE_NOT_CURRENT'
      WHEN f.largest > 1 THEN 'EVIDENCE_GROUP_VALUE_PROJECTION_UNSUPPORTED' WHEN NOT f.exact THEN 'VALUE_NOT_EXACT_SOURCE_TEXT' END AS code FROM props p JOIN firsts USING (item_id) LEFT JOIN f USING (item_id))
    SELECT item_id, CASE WHEN code IS NULL THEN 'verified' WHEN code IN ('EVIDENCE_GROUP_VALUE_PROJECTION_UNSUPPORTED', 'VALUE_NOT_EXACT_SOURCE_TEXT') THEN 'abstained' ELSE 'rejected' END AS outcome, code FROM coded"""
)
def proposal_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of every search against its bundle of groups and single entries: verified, rejected with a code, or abstained from."""
    evidence = cut(_evidence(spark, sf_dir))
    units = cut(_group_units(spark, sf_dir, evidence))
    packed = pack(units, "item_id", max_bytes=MAX_BYTES, max_entries=MAX_ENTRIES, unit="unit").filter("label IS NOT NULL")
    entries = cut(packed.select("item_id", "doc_id", "label").join(units, ["item_id", "doc_id"]))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    cited = docs.join(entries.select("doc_id").distinct(), "doc_id", "left_semi")
    newest = docs.join(cited.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.max("doc_id").alias("doc_id"))
    named = F.struct("rank", "label", "doc_id", "unit", "text")
    firsts = entries.groupBy("item_id").agg(F.sort_array(F.collect_list(named)).alias("e"))
    mine = F.filter("e", lambda x: x["unit"] == F.get("e", F.lit(0))["unit"])
    fingerprint = F.sha2(F.array_join(F.transform("e", lambda x: F.concat(x["label"], F.lit(":"), x["doc_id"].cast("string"))), ","), 256)
    firsts = cut(firsts.select("item_id", fingerprint.alias("fingerprint"), F.get("e", F.lit(0))["text"].alias("text"), F.element_at("e", -1)["label"].alias("last"), F.transform(mine, lambda x: x["label"]).alias("unit_labels")))
    kind = F.col("item_id") % 10
    cite = lambda *labels: F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
    proposals = table(spark, sf_dir, "benchmark").select("item_id").join(firsts, "item_id").select(
        "item_id",
        F.when(kind == 4, "other-policy").otherwise(POLICY).alias("policy"),
        F.when(kind == 5, F.sha2("fingerprint", 256)).otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(kind == 1, F.concat("text", F.lit(" "))).when(kind == 7, F.repeat("text", 40)).otherwise(F.col("text")).alias("value"),
        F.when(kind == 2, cite("E1", "E99")).when(kind == 3, cite("E1", "E1")).when(kind == 6, cite()).when(kind == 8, F.array("last")).when(kind == 9, cite("E1", "E2", "E3")).otherwise(F.col("unit_labels")).alias("labels"),
    )
    return verify_proposals(proposals, entries, firsts, newest.select("doc_id"), "item_id")


#: Proposals of one value under cited labels: the text of E1, spoilt in some, cited with E2, with a label that is not there, or twice in others.
PROPOSALS_SQL = """, proposals AS (SELECT p.item_id, e.chunk_text || CASE WHEN p.item_id % 5 = 1 THEN ' ' ELSE '' END AS value, CASE p.item_id % 5 WHEN 2 THEN ['E1', 'E2'] WHEN 3 THEN ['E1', 'E99'] WHEN 4 THEN ['E1', 'E1'] ELSE ['E1'] END AS labels
  FROM packed p JOIN evidence e ON e.item_id = p.item_id AND e.doc_id = p.doc_id WHERE p.label = 'E1')
"""


@query(
    PACK_SQL
    + PROPOSALS_SQL
    + """, cited AS (SELECT item_id, value, len(labels) AS n_labels, unnest(labels) AS label FROM proposals), bound AS (SELECT c.item_id, c.label, c.n_labels, c.value, e.chunk_text FROM cited c LEFT JOIN packed p ON p.item_id = c.item_id AND p.label = c.label LEFT JOIN evidence e ON e.item_id = p.item_id AND e.doc_id = p.doc_id)
    SELECT item_id, CASE WHEN count(DISTINCT label) < max(n_labels) THEN 'EVIDENCE_REFERENCE_INVALID' WHEN count(chunk_text) < count(*) THEN 'EVIDENCE_REFERENCE_INVALID' WHEN bool_and(value = chunk_text) THEN 'verified' ELSE 'VALUE_NOT_EXACT_SOURCE_TEXT' END AS outcome FROM bound GROUP BY item_id"""
)
def exact_text_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a proposal's value is, byte for byte, the text of every entry that it cites; faulty citations are rejected."""
    evidence = cut(_evidence(spark, sf_dir))
    packed = cut(_packed(spark, sf_dir, evidence).filter("label IS NOT NULL"))
    entries = packed.join(evidence.select("item_id", "doc_id", F.col("chunk_text").alias("text")), ["item_id", "doc_id"]).select("item_id", "label", "text")
    kind = F.col("item_id") % 5
    labels = F.when(kind == 2, F.array(F.lit("E1"), F.lit("E2"))).when(kind == 3, F.array(F.lit("E1"), F.lit("E99"))).when(kind == 4, F.array(F.lit("E1"), F.lit("E1"))).otherwise(F.array(F.lit("E1")))
    proposals = entries.filter("label = 'E1'").select("item_id", F.concat("text", F.when(kind == 1, " ").otherwise("")).alias("value"), labels.alias("labels"))
    cited = proposals.select("item_id", "value", F.size("labels").alias("n_labels"), F.explode("labels").alias("label"))
    bound = cited.join(entries, ["item_id", "label"], "left")
    repeated, unbound = F.countDistinct("label") < F.max("n_labels"), F.count("text") < F.count("*")
    outcome = F.when(repeated | unbound, "EVIDENCE_REFERENCE_INVALID").when(F.bool_and(F.encode("value", "UTF-8") == F.encode("text", "UTF-8")), "verified").otherwise("VALUE_NOT_EXACT_SOURCE_TEXT")
    return bound.groupBy("item_id").agg(outcome.alias("outcome"))


@query(
    EVIDENCE_SQL
    + """SELECT count(*) AS n_hits, count(*) FILTER (d.source IS DISTINCT FROM 'src3') AS out_of_scope, count(*) FILTER (p.doc_id IS NULL) AS no_page, count(*) FILTER (e.start_offset < 0 OR e.end_offset <= e.start_offset OR e.end_offset > length(p.t)) AS bad_range, count(*) FILTER (p.t[e.start_offset + 1 : e.end_offset] <> e.chunk_text) AS other_text, count(*) FILTER (len(string_split(e.chunk_text, ' ')) <> e.n_words) AS other_anchors
    FROM evidence e JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, page_index, array_to_string(page_words, ' ') AS t FROM pages_) p ON p.doc_id = e.doc_id AND p.page_index = e.page_index"""
)
def hit_scope_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits against the scope of one source and against their pages: violations by kind; only those of scope may be there."""
    evidence = cut(_evidence(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").join(evidence.select("doc_id").distinct(), "doc_id", "left_semi")
    page_rows = pages(docs).select("doc_id", "page_index", "page_text")
    rows = evidence.join(docs.select("doc_id", "source"), "doc_id").join(page_rows, ["doc_id", "page_index"], "left")
    slice_ = F.substring(F.col("page_text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    start, end = F.col("start_offset"), F.col("end_offset")
    return rows.agg(
        F.count("*").alias("n_hits"),
        F.count_if(~F.col("source").eqNullSafe(F.lit("src3"))).alias("out_of_scope"),
        F.count_if(F.col("page_text").isNull()).alias("no_page"),
        F.count_if((start < 0) | (end <= start) | (end > F.length("page_text"))).alias("bad_range"),
        F.count_if(slice_ != F.col("chunk_text")).alias("other_text"),
        F.count_if(F.size(F.split("chunk_text", " ")) != F.col("n_words")).alias("other_anchors"),
    )


@query("""SELECT item_id, sha256('{"limit":10,"mode":"hybrid","query":' || to_json(text)::VARCHAR || ',"scope":"src' || (item_id % 20) || '"}') AS fingerprint FROM benchmark""")
def scoped_request_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each scoped search: the digest of its canonical JSON."""
    scope = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    body = F.to_json(F.struct(F.lit(10).alias("limit"), F.lit("hybrid").alias("mode"), F.col("text").alias("query"), scope.alias("scope")))
    return table(spark, sf_dir, "benchmark").select("item_id", sealed(body).alias("fingerprint"))


_ADMIT = "SELECT conv_id, turn, role, sum(len(string_split(text, ' '))) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS prompt_tokens FROM conversations"


def _admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sum(F.size(F.split("text", " "))).over(so_far).alias("prompt_tokens"))


@query(f"SELECT conv_id, turn, prompt_tokens, prompt_tokens + 16 <= 160 AS admitted FROM ({_ADMIT})")
def prompt_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the prompt up to each turn and the reserve fit the context."""
    return _admission(spark, sf_dir).select("conv_id", "turn", "prompt_tokens", (F.col("prompt_tokens") + 16 <= 160).alias("admitted"))


@query(f"SELECT conv_id, CASE WHEN NOT bool_or(role = 'user') THEN 'rejected' WHEN max(prompt_tokens) + 16 > 160 THEN 'failed' WHEN arg_max(role, turn) = 'user' THEN 'abstained' ELSE 'answered' END AS outcome, count(*) AS n_turns FROM ({_ADMIT}) GROUP BY conv_id")
def outcome_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of each conversation."""
    outcome = F.when(~F.bool_or(F.col("role") == "user"), "rejected").when(F.max("prompt_tokens") + 16 > 160, "failed").when(F.max_by("role", "turn") == "user", "abstained").otherwise("answered")
    return _admission(spark, sf_dir).groupBy("conv_id").agg(outcome.alias("outcome"), F.count("*").alias("n_turns"))


@query(
    PACK_SQL
    + f""", prompts AS (SELECT p.item_id, '{{"evidence":[' || string_agg({_entry("p.doc_id", "p.label", "e.chunk_text")}, ',' ORDER BY p.rank) || '],"question":' || to_json(any_value(b.text))::VARCHAR || '}}' AS body FROM packed p JOIN evidence e ON e.item_id = p.item_id AND e.doc_id = p.doc_id JOIN benchmark b ON b.item_id = p.item_id WHERE p.label IS NOT NULL GROUP BY p.item_id)
    SELECT item_id, length(body)::INT AS prompt_chars, sha256(body) AS prompt_sha256, strlen(body) // 4 + 1024 <= 4096 AS admitted FROM prompts"""
)
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt's canonical JSON: the question, and the packed evidence as data under labels; admitted if it fits the context (four bytes a token)."""
    evidence = cut(_evidence(spark, sf_dir))
    questions = table(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.struct(F.col("text").alias("question"))).alias("q"))
    joined = _bodies(_packed(spark, sf_dir, evidence), evidence).join(questions, "item_id")
    # Both are objects of one field: the first without its end, the second without its beginning.
    body = F.concat(F.substr("body", F.lit(1), F.length("body") - 1), F.lit(","), F.substr("q", F.lit(2)))
    return joined.select("item_id", body.alias("body")).select("item_id", F.length("body").alias("prompt_chars"), F.sha2("body", 256).alias("prompt_sha256"), (F.floor(F.octet_length("body") / 4) + 1024 <= 4096).alias("admitted"))

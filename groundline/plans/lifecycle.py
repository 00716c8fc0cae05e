"""Queries over a publication log: current pointers, state transitions, reconciliation.

``events`` is the log: user_id is the key, (ts, event_id) the sequence,
event_id the generation and event_type the state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.operators.ranking import numbered_by
from groundline.plans.registry import query
from groundline.sources.checkpoints import ensure_checkpoint_dir
from groundline.sources.tables import table
from groundline.streaming.lifecycle import OUT, checked_steps


def latest(log: DataFrame, key: str, *sequence: str) -> DataFrame:
    """The last row of each key, as one aggregation: a hot key is combined before the shuffle."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.struct(*sequence)).alias("row")).select("row.*")


@query("SELECT user_id, event_id AS generation_id, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current generation of every key."""
    return latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", F.col("event_id").alias("generation_id"), F.col("event_type").alias("state"))


@query("SELECT before, state, count(*) AS n, count(*) FILTER (gap < 60) AS n_within_minute FROM (SELECT event_type AS state, lag(event_type) OVER w AS before, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before IS NOT NULL GROUP BY ALL")
def state_transition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each state follows each other, in the log of each key."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("state"), F.lag("event_type").over(w).alias("before"), (micros - F.lag(micros).over(w)).alias("gap"))
    return steps.filter("before IS NOT NULL").groupBy("before", "state").agg(F.count("*").alias("n"), F.count_if(F.col("gap") < 60_000_000).alias("n_within_minute"))


@query(
    """WITH cur AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS published FROM events WHERE event_type <> 'error' GROUP BY user_id), n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
    SELECT e.user_id, e.event_id AS generation_id, CASE WHEN e.event_id = c.published THEN 'keep' WHEN e.event_id > c.published THEN 'publish' WHEN e.event_type = 'error' THEN 'discard' ELSE 'stale' END AS action, n.n AS n_generations FROM events e LEFT JOIN cur c USING (user_id) JOIN n USING (user_id)"""
)
def reconcile_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recovery does with every generation, from the pointers and the log."""
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    pointers = latest(log.filter("event_type <> 'error'"), "user_id", "ts", "event_id").select("user_id", F.col("event_id").alias("published"))
    counts = log.groupBy("user_id").agg(F.count("*").alias("n_generations"))
    action = F.when(F.col("event_id") == F.col("published"), "keep").when(F.col("event_id") > F.col("published"), "publish").when(F.col("event_type") == "error", "discard").otherwise("stale")
    return log.join(pointers, "user_id", "left").join(counts, "user_id").select("user_id", F.col("event_id").alias("generation_id"), action.alias("action"), "n_generations")


@query("SELECT o_custkey, CASE count(*) WHEN 1 THEN 'sole' ELSE 'ambiguous' END AS outcome, CASE WHEN count(*) = 1 THEN max(o_orderkey) END AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def sole_current_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one order in progress of a customer, or that there are several."""
    one = F.count("*") == 1
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.when(one, "sole").otherwise("ambiguous").alias("outcome"), F.when(one, F.max("o_orderkey")).alias("o_orderkey"))


@query("SELECT event_type, CASE event_type WHEN 'signup' THEN 'DB_CANDIDATE' WHEN 'click' THEN 'FILES_FINALIZED' ELSE 'STALE' END AS state, count(*) AS n, count(DISTINCT user_id) AS n_keys FROM events GROUP BY ALL")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations and keys in each state."""
    state = F.when(F.col("event_type") == "signup", "DB_CANDIDATE").when(F.col("event_type") == "click", "FILES_FINALIZED").otherwise("STALE")
    return table(spark, sf_dir, "events").groupBy("event_type", state.alias("state")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_keys"))


@query("SELECT e.user_id, e.event_id FROM events e WHERE e.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.ts < e.ts)")
def pointer_lineage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that no earlier view of the same key supports (a trigger as a violation query).

    Only the first view matters, so each key is joined with one row.
    """
    log = table(spark, sf_dir, "events")
    first = log.filter("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("first_view"))
    joined = log.filter("event_type = 'purchase'").join(first, "user_id", "left")
    return joined.filter("first_view IS NULL OR first_view >= ts").select("user_id", "event_id")


@query(
    """WITH was AS (SELECT source, sum(('0x' || substring(sha256(doc_id || ':' || coalesce(text, '')), 1, 12))::UBIGINT)::VARCHAR AS h FROM documents WHERE NOT (doc_id % 400 = 3) GROUP BY source), is_ AS (SELECT source, sum(('0x' || substring(sha256(doc_id || ':' || coalesce(text, '')), 1, 12))::UBIGINT)::VARCHAR AS h FROM documents GROUP BY source),
    published AS (SELECT source, 'generation-' || sha256(h) AS generation_id, h FROM was)
    SELECT is_.source, CASE WHEN p.h = is_.h THEN p.generation_id END AS generation_id, CASE WHEN p.source IS NULL THEN 'unavailable' WHEN p.h = is_.h THEN 'current' ELSE 'stale' END AS state FROM is_ LEFT JOIN published p ON p.source IS NOT DISTINCT FROM is_.source"""
)
def active_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published generation of each source, null where its documents have changed since (some ids came later)."""
    docs = table(spark, sf_dir, "documents")
    digest = F.conv(F.substring(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    snapshot = lambda rows: F.sum(rows).cast("string")
    late = F.col("doc_id") % 400 == 3
    # Both snapshots come from one pass: the later rows count in one of them only.
    both = docs.groupBy("source").agg(snapshot(F.when(~late, digest)).alias("was"), snapshot(digest).alias("now"))
    same = F.col("was") == F.col("now")
    generation = F.concat(F.lit("generation-"), F.sha2("was", 256))
    return both.select("source", F.when(same, generation).alias("generation_id"), F.when(F.col("was").isNull(), "unavailable").when(same, "current").otherwise("stale").alias("state"))


@query("WITH c AS (SELECT label, count(*) AS n_vectors, count(*) FILTER (vec_id % 9 <> 0 AND label <> 4) AS n_embeddable FROM embeddings GROUP BY label) SELECT label, n_vectors, n_embeddable, CASE WHEN n_embeddable = 0 THEN 'empty' WHEN n_embeddable < n_vectors THEN 'partial' ELSE 'full' END AS artifact, CASE WHEN n_embeddable = 0 THEN 0 ELSE 1 END::INT AS n_files FROM c")
def empty_generation_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each generation of vectors publishes: one without embeddable spans is explicitly empty, not missing."""
    embeddable = (F.col("vec_id") % 9 != 0) & (F.col("label") != 4)
    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n_vectors"), F.count_if(embeddable).alias("n_embeddable"))
    none = F.col("n_embeddable") == 0
    return c.withColumn("artifact", F.when(none, "empty").when(F.col("n_embeddable") < F.col("n_vectors"), "partial").otherwise("full")).withColumn("n_files", F.when(none, 0).otherwise(1))


@query(
    """WITH spans AS (SELECT vec_id, label, len(embedding) AS dim, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS vector_row FROM embeddings)
    SELECT s.label, count(*) AS n_rows, count(DISTINCT s.vec_id) AS n_spans, count(d.doc_id) AS n_with_parent, count(*) FILTER (d.doc_id IS NULL) AS orphans, min(vector_row) = 0 AND max(vector_row) = count(*) - 1 AND count(DISTINCT vector_row) = count(*) AS bijective,
      count(*) FILTER (abs(norm - 1) > 1e-5) AS not_unit, count(*) FILTER (dim <> 64) AS other_dimension, count(DISTINCT d.source) AS n_sources, CASE WHEN count(*) FILTER (d.doc_id IS NULL OR abs(norm - 1) > 1e-5 OR dim <> 64) = 0 THEN 'valid' ELSE 'invalid' END AS verdict
    FROM spans s LEFT JOIN documents d ON d.doc_id = s.vec_id GROUP BY s.label"""
)
def vector_generation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector generation as a whole: rows and spans one to one, every span's parent there, unit vectors of one dimension."""
    v = table(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    spans = numbered_by(v.select("label", "vec_id", F.size("embedding").alias("dim"), norm.alias("norm")), "label", "vec_id", "vector_row")
    parents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", F.lit(True).alias("found"))
    rows = spans.join(parents, "vec_id", "left")
    orphan, bent, odd = F.col("found").isNull(), F.abs(F.col("norm") - 1) > 1e-5, F.col("dim") != 64
    n = F.count("*")
    # Distinct spans and rows are counted first by span: a span has few rows.
    per_span = rows.groupBy("label", "vec_id", "source").agg(n.alias("n"), F.count("found").alias("p"), F.count_if(orphan).alias("o"), F.count_if(bent).alias("b"), F.count_if(odd).alias("x"), F.count_if(orphan | bent | odd).alias("bad"), F.min("vector_row").alias("low"), F.max("vector_row").alias("high"))
    total = lambda c: F.sum(c)
    return per_span.groupBy("label").agg(
        total("n").alias("n_rows"),
        n.alias("n_spans"),
        total("p").alias("n_with_parent"),
        total("o").alias("orphans"),
        ((F.min("low") == 0) & (F.max("high") == F.sum("n") - 1) & (F.sum("n") == n)).alias("bijective"),
        total("b").alias("not_unit"),
        total("x").alias("other_dimension"),
        F.countDistinct("source").alias("n_sources"),
        F.when(F.sum("bad") == 0, "valid").otherwise("invalid").alias("verdict"),
    )


_STEPS_SQL = """log AS (SELECT user_id AS g, (ts, event_id) AS spot, event_id, CASE event_type WHEN 'signup' THEN 'DB_CANDIDATE' WHEN 'click' THEN 'FILES_FINALIZED' ELSE 'STALE' END AS state FROM events),
one AS (SELECT g, min(spot) AS one FROM log WHERE state = 'DB_CANDIDATE' GROUP BY g),
two AS (SELECT g, min(spot) AS two, arg_min(state, spot) AS second FROM log JOIN one USING (g) WHERE spot > one AND state IN ('FILES_FINALIZED', 'STALE') GROUP BY g),
three AS (SELECT g, min(spot) AS three FROM log JOIN two USING (g) WHERE spot > two AND second = 'FILES_FINALIZED' AND state = 'STALE' GROUP BY g)"""


@query(
    f"""WITH {_STEPS_SQL}
    SELECT g AS generation_id, event_id, CASE WHEN one IS NULL OR spot <= one THEN NULL WHEN two IS NULL OR spot <= two THEN 'DB_CANDIDATE' WHEN three IS NULL OR spot <= three THEN second ELSE 'STALE' END AS before, state,
      CASE WHEN coalesce(spot = one, false) OR coalesce(spot = two, false) OR coalesce(spot = three, false) THEN 'legal' ELSE 'illegal' END AS outcome FROM log LEFT JOIN one USING (g) LEFT JOIN two USING (g) LEFT JOIN three USING (g)"""
)
def lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream with the state of each generation: every step with the state before it and whether it is legal."""
    source = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "signup", "DB_CANDIDATE").when(F.col("event_type") == "click", "FILES_FINALIZED").otherwise("STALE")
    log = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]").select(F.col("user_id").alias("generation_id"), "ts", "event_id", state.alias("state"))
    root = f"{ensure_checkpoint_dir(spark)}/lifecycle-{uuid.uuid4().hex}"
    run = checked_steps(log).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{root}/out")

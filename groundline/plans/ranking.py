"""Queries of planning, ranking, fusion and evaluation.

Search queries are the texts of ``benchmark``; the vector of search i is the
one with id 50 i. Documents and vectors with one id are one parent. Planned
searches are the sentences of ``benchmark``, as plans admit few terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.functions.text import INTENTS, STOP_WORDS, TOKEN, WHITE, query_terms, tokens, variants
from groundline.operators import planning
from groundline.operators.ranking import bm25, bm25_sums, cosine_best, counted, counted_sums, dot, fuse, numbered_by, pareto_layers, ranking_metrics, top_k
from groundline.plans.registry import query
from groundline.sources.checkpoints import cut
from groundline.sources.tables import table

TOP, DEPTH = 10, 50
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
STOPPED = "list_filter(regexp_extract_all({0}, '{1}'), lambda w: NOT list_contains(string_split('{2}', ' '), w))".format(LOWER.format("text"), TOKEN, " ".join(STOP_WORDS))

LEXICAL_SQL = rf"""
q AS (SELECT item_id, unnest(list_distinct({STOPPED})) AS term FROM benchmark),
d AS (SELECT doc_id, source, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM d),
tf AS (SELECT term, doc_id, source, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, source, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
idf AS (SELECT term, greatest(ln((any_value(s.n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf, s GROUP BY term),
scored AS (SELECT item_id, doc_id, any_value(source) AS source, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / s.mean))), 9) AS score FROM tf JOIN idf USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id),
lexical AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id)::INT AS rank FROM scored) WHERE rank <= {DEPTH})
"""
#: The stated query set: every vector whose id is divisible by 50.
SEMANTIC_SQL = f"""
qv AS (SELECT vec_id // 50 AS item_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
cos_ AS (SELECT item_id, vec_id AS doc_id, label, round(list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(q, q)), 9) AS score FROM embeddings, qv),
semantic AS (SELECT * FROM (SELECT item_id, doc_id, label, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM cos_) WHERE rank <= {DEPTH})
"""
FUSED_SQL = f"""
joined AS (SELECT coalesce(l.item_id, s.item_id) AS item_id, coalesce(l.doc_id, s.doc_id) AS doc_id, l.rank AS lexical_rank, s.rank AS semantic_rank FROM lexical l FULL JOIN semantic s ON l.item_id = s.item_id AND l.doc_id = s.doc_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, least(coalesce(lexical_rank, 2147483647), coalesce(semantic_rank, 2147483647)), channels DESC, coalesce(lexical_rank, 2147483647), coalesce(semantic_rank, 2147483647), doc_id)::INT AS fused_rank FROM (
  SELECT *, CASE WHEN semantic_rank IS NULL THEN 1 / (lexical_rank + 40)::DOUBLE WHEN lexical_rank IS NULL THEN 1 / (semantic_rank + 40)::DOUBLE ELSE (lexical_rank + semantic_rank + 80)::DOUBLE / ((lexical_rank + 40) * (semantic_rank + 40)) END AS score,
    (CASE WHEN lexical_rank IS NULL THEN 0 ELSE 1 END + CASE WHEN semantic_rank IS NULL THEN 0 ELSE 1 END) AS channels FROM joined))
"""


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(query_terms(F.col("text"))).alias("term"))


def lexical(spark: SparkSession, sf_dir: str, k: int = DEPTH) -> DataFrame:
    scored = bm25(table(spark, sf_dir, "documents"), search_terms(spark, sf_dir), query_key="item_id")
    return top_k(scored, "item_id", [F.col("score"), F.col("doc_id")], k)


def semantic(spark: SparkSession, sf_dir: str, k: int = DEPTH, block: int = 4096) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    best = cosine_best(vectors, vectors.filter("vec_id % 50 = 0"), k, block=block)
    return best.select(F.floor(F.col("query_id") / 50).alias("item_id"), F.col("vec_id").alias("doc_id"), "score", "rank")


def fused(spark: SparkSession, sf_dir: str, first: DataFrame | None = None) -> DataFrame:
    return fuse(lexical(spark, sf_dir) if first is None else first, semantic(spark, sf_dir), ["item_id", "doc_id"])


@query("WITH " + LEXICAL_SQL + f"SELECT item_id, doc_id, rank, round(score, 6) AS score FROM lexical WHERE rank <= {TOP}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-corpus BM25: the ten best documents for each search."""
    return lexical(spark, sf_dir, TOP).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("WITH " + LEXICAL_SQL + f"SELECT item_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id)::INT AS rank FROM scored WHERE source = 'src3') WHERE rank <= {TOP}")
def bm25_scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 within one source; the statistics stay those of the whole corpus."""
    scored = bm25(table(spark, sf_dir, "documents"), search_terms(spark, sf_dir), query_key="item_id", eligible=F.col("source") == "src3")
    return top_k(scored, "item_id", [F.col("score"), F.col("doc_id")], TOP).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("WITH " + SEMANTIC_SQL + f"SELECT item_id, doc_id AS vec_id, rank, round(score, 6) AS score FROM semantic WHERE rank <= {TOP}")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine: the ten best vectors for each query vector."""
    return semantic(spark, sf_dir, TOP).select("item_id", F.col("doc_id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query("WITH " + SEMANTIC_SQL + f"SELECT item_id, doc_id AS vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM cos_ WHERE label = 3) WHERE rank <= {TOP}")
def cosine_scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine among the vectors of one label; the filter comes before any score."""
    vectors = table(spark, sf_dir, "embeddings")
    best = cosine_best(vectors.filter("label = 3"), vectors.filter("vec_id % 50 = 0"), TOP)
    return best.select(F.floor(F.col("query_id") / 50).alias("item_id"), "vec_id", "rank", F.round("score", 6).alias("score"))


@query(
    """SELECT vec_id, CASE WHEN list_bool_or(list_transform(e, lambda x: isnan(x) OR isinf(x))) THEN 'not finite' WHEN n2 = 0 THEN 'zero' WHEN abs(sqrt(n2) - 1) > 1e-5 THEN 'not unit' ELSE 'ok' END AS state
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n2 FROM embeddings)"""
)
def vector_norm_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each vector is finite and of unit length."""
    n2 = dot(F.col("embedding"), F.col("embedding"))
    odd = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    state = F.when(odd, "not finite").when(n2 == 0, "zero").when(F.abs(F.sqrt(n2) - 1) > 1e-5, "not unit").otherwise("ok")
    return table(spark, sf_dir, "embeddings").select("vec_id", state.alias("state"))


@query("SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS vector_row FROM embeddings")
def vector_row_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical row numbers of the vectors of each label."""
    return numbered_by(table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id", "vector_row")


@query("WITH " + SEMANTIC_SQL + "SELECT item_id, doc_id // 4 AS parent_id, arg_min(doc_id, rank) AS span_id, min(rank) AS rank, count(*) AS n_spans FROM semantic GROUP BY ALL")
def best_span_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four spans make a parent, which keeps its best span and that span's rank."""
    spans = semantic(spark, sf_dir).withColumn("parent_id", F.floor(F.col("doc_id") / 4))
    return spans.groupBy("item_id", "parent_id").agg(F.min_by("doc_id", "rank").alias("span_id"), F.min("rank").alias("rank"), F.count("*").alias("n_spans"))


@query("WITH " + LEXICAL_SQL + "," + SEMANTIC_SQL + "," + FUSED_SQL + f"SELECT item_id, doc_id, lexical_rank, semantic_rank, round(score, 9) AS score, channels, fused_rank FROM fused WHERE fused_rank <= {TOP}")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of the lexical and the semantic channel, ten best."""
    return fused(spark, sf_dir).filter(F.col("fused_rank") <= TOP).withColumn("score", F.round("score", 9))


@query("WITH " + LEXICAL_SQL + "," + SEMANTIC_SQL + "," + FUSED_SQL + "SELECT item_id, CASE WHEN channels = 2 THEN 'both' WHEN lexical_rank IS NULL THEN 'semantic' ELSE 'lexical' END AS membership, count(*) AS n FROM fused GROUP BY ALL")
def rrf_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each channel gave alone and how many both."""
    membership = F.when(F.col("channels") == 2, "both").when(F.col("lexical_rank").isNull(), "semantic").otherwise("lexical")
    return fused(spark, sf_dir).groupBy("item_id", membership.alias("membership")).agg(F.count("*").alias("n"))


def ordered(items: str) -> str:
    """SQL of a list's different items in their order."""
    return f"list_transform(list_filter(list_zip(range(1, len({items}) + 1), {items}), lambda x: list_position({items}, x[2]) = x[1]), lambda x: x[2])"


_STOP_SQL = "list_contains(string_split('{0}', ' '), {{0}})".format(" ".join(STOP_WORDS))


def plan_sql(name: str, rows: str, key: str) -> str:
    """CTEs that state the plan of each row ``key, whole`` of ``rows``: its terms and its state, by the limits."""
    clean = r"replace(replace(replace(whole, chr(9), ''), chr(10), ''), chr(13), '')"
    return rf"""
{name}_scan AS (SELECT {key}, whole, low, regexp_extract_all(low, '{TOKEN}') AS a FROM (SELECT {key}, whole, {LOWER.format("nfc_normalize(whole)")} AS low FROM ({rows}))),
{name}_kept AS (SELECT *, list_filter(a, lambda w: NOT {_STOP_SQL.format("w")}) AS kept FROM {name}_scan),
{name}_terms AS (SELECT *, {ordered("kept")} AS terms FROM {name}_kept),
{name} AS (SELECT {key}, terms, CASE
  WHEN strlen(whole) > 4096 OR len(list_filter(string_split(trim(regexp_replace(whole, '{WHITE}', ' ', 'g')), ' '), lambda w: w <> '')) > 128 THEN 'resource_limit'
  WHEN regexp_matches({clean}, '[\p{{Cc}}\p{{Cf}}]') THEN 'unsupported_characters'
  WHEN strlen(low) > 4096 OR len(a) > 256 OR len(list_filter(a, lambda t: length(t) > 64 OR strlen(t) > 128)) > 0 THEN 'resource_limit'
  WHEN len(terms) = 0 THEN 'no_terms'
  WHEN len(terms) > 32 OR strlen(array_to_string(terms, '')) + 6 * len(terms) - 4 > 8192 THEN 'resource_limit' ELSE 'ok' END AS state FROM {name}_terms)
"""


_FORMS = """CASE WHEN NOT regexp_matches(term, '^[a-z][a-z0-9]*$') THEN [] ELSE [CASE WHEN regexp_matches(term, '[b-df-hj-np-tv-xz]y$') THEN substring(term, 1, length(term) - 1) || 'ies' WHEN regexp_matches(term, '(s|x|z|ch|sh)$') THEN term || 'es' ELSE term || 's' END,
  CASE WHEN term LIKE '%e' THEN term || 'd' WHEN regexp_matches(term, '[b-df-hj-np-tv-xz]y$') THEN substring(term, 1, length(term) - 1) || 'ied' ELSE term || 'ed' END,
  CASE WHEN term LIKE '%e' AND term NOT LIKE '%ee' THEN substring(term, 1, length(term) - 1) ELSE term END || 'ing'] END"""
_FAMILIES = ", ".join(f"({k}, '{f}', {calls}, {adds})" for k, (f, (calls, adds)) in enumerate(INTENTS.items()))
SENTENCES_SQL = "SELECT item_id * 1000 + k - 1 AS query_id, whole FROM (SELECT item_id, unnest(string_split(text, '.')) AS whole, generate_subscripts(string_split(text, '.'), 1) AS k FROM benchmark)"
BRANCHES_SQL = (
    plan_sql("plans", SENTENCES_SQL, "query_id")
    + f""",
families(no, family, calls, adds) AS (VALUES {_FAMILIES}),
ok AS (SELECT query_id, terms FROM plans WHERE state = 'ok'),
forms AS (SELECT query_id, terms, i, {ordered("v")} AS v FROM (SELECT query_id, terms, i, {_FORMS} AS v FROM (SELECT query_id, terms, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS i FROM ok))),
called AS (SELECT query_id, terms, family, adds, row_number() OVER (PARTITION BY query_id ORDER BY no) - 1 AS i FROM ok, families WHERE list_has_any(terms, calls)),
pending AS (
  SELECT query_id, 0 AS o1, 0 AS o2, 0 AS o3, 'base-000' AS branch_id, 'base' AS kind, terms FROM ok
  UNION ALL SELECT query_id, 1, i, k, 'morphology-' || lpad(i::VARCHAR, 3, '0') || '-' || lpad(k::VARCHAR, 3, '0'), 'morphology', CASE WHEN list_contains(terms, x) OR {_STOP_SQL.format("x")} THEN terms ELSE list_append(terms, x) END
    FROM (SELECT query_id, terms, i, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS k FROM forms)
  UNION ALL SELECT query_id, 2, i, 0, 'intent-' || lpad(i::VARCHAR, 3, '0') || '-' || family, 'intent', list_concat(terms, list_filter(adds, lambda w: NOT list_contains(terms, w))) FROM called),
unique_ AS (SELECT query_id, terms, min((o1, o2, o3)) AS o, arg_min(branch_id, (o1, o2, o3)) AS branch_id, arg_min(kind, (o1, o2, o3)) AS kind, count(*) - 1 AS n_aliases FROM pending GROUP BY query_id, terms),
sizes AS (SELECT query_id, len(terms) + coalesce((SELECT sum(len(v)) FROM forms f WHERE f.query_id = ok.query_id), 0) + coalesce((SELECT sum(len(adds)) FROM called c WHERE c.query_id = ok.query_id), 0) AS expanded, (SELECT count(*) FROM called c WHERE c.query_id = ok.query_id) AS n_families FROM ok),
admitted AS (SELECT query_id FROM sizes JOIN (SELECT query_id, count(*) AS n, max(len(terms)) AS longest, max(strlen(array_to_string(terms, '')) + 6 * len(terms) - 4) AS bytes FROM unique_ GROUP BY query_id) USING (query_id)
  WHERE n_families <= 2 AND expanded <= 64 AND n <= 16 AND longest <= 32 AND bytes <= 8192),
branches AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY o) - 1)::INT AS place, branch_id, kind, terms, n_aliases FROM unique_ JOIN admitted USING (query_id))
"""
)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.")).alias("k", "whole"))
    return each.select((F.col("item_id") * 1000 + F.col("k")).alias("query_id"), "whole")


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planning.branches(planning.plan(sentences(spark, sf_dir), "query_id", "whole"), "query_id")
    return found.filter("state = 'ok'").select("query_id", F.explode("branches").alias("b")).select("query_id", "b.*")


_TURNS = "SELECT conv_id, turn, coalesce(text, '') AS whole FROM conversations WHERE role = 'user'"


@query("WITH " + plan_sql("plans", _TURNS, "conv_id, turn") + "SELECT conv_id, turn, state, array_to_string(terms, ' ') AS terms FROM plans")
def query_terms_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every user turn: ordered distinct terms without function words, admitted or rejected by the limits."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.struct("conv_id", "turn").alias("key"), "text")
    return planning.plan(turns, "key", "text").select("key.*", "state", F.array_join("terms", " ").alias("terms"))


@query("WITH " + BRANCHES_SQL + "SELECT query_id, place, branch_id, kind, array_to_string(terms, ' ') AS terms, n_aliases::INT AS n_aliases FROM branches")
def multi_query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of every admitted sentence: base, one per variant of a term, one per intent family; equal ones once."""
    return _branches(spark, sf_dir).select("query_id", "place", "branch_id", "kind", F.array_join("terms", " ").alias("terms"), F.size("aliases").alias("n_aliases"))


@query("WITH " + BRANCHES_SQL + "SELECT CASE WHEN p.state <> 'ok' THEN p.state WHEN a.query_id IS NULL THEN 'resource_limit' ELSE 'ok' END AS state, count(*) AS n FROM plans p LEFT JOIN admitted a USING (query_id) GROUP BY 1")
def plan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences are admitted as multi-queries, and why the others are not."""
    plans = planning.plan(sentences(spark, sf_dir), "query_id", "whole")
    final = planning.branches(plans, "query_id").select("query_id", F.col("state").alias("final"))
    return plans.join(final, "query_id", "left").groupBy(F.coalesce("final", "state").alias("state")).agg(F.count("*").alias("n"))


@query(
    "WITH "
    + BRANCHES_SQL
    + rf""", bt AS (SELECT query_id, place, unnest(terms) AS term FROM branches),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents),
    s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM d),
    tf AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM bt) GROUP BY ALL),
    idf AS (SELECT term, greatest(ln((any_value(s.n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf, s GROUP BY term),
    sc AS (SELECT query_id, place, doc_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / s.mean))), 9) AS score FROM tf JOIN idf USING (term) JOIN bt USING (term), s GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY score, doc_id) AS rank FROM sc QUALIFY rank <= {DEPTH}),
    mg AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)::DOUBLE), 12) AS score, min(rank) AS best_rank, count(*) AS n_branches, arg_min(place, (rank, place)) AS first_branch FROM rk GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 9) AS score, best_rank::INT AS best_rank, n_branches, first_branch, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, n_branches DESC, first_branch, doc_id)::INT AS rank FROM mg QUALIFY rank <= {TOP}"""
)
def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All branches of every admitted sentence searched and merged by summed reciprocal ranks.

    A branch adds terms to its base, and terms only better a score. So its first
    documents are among those that have an added term and the base's first ones:
    the base is scored once, and the rest of each branch by its added terms.
    """
    each = cut(_branches(spark, sf_dir).select("query_id", "place", "terms"))
    base = each.filter("place = 0").select("query_id", F.col("terms").alias("base"))
    added = each.filter("place > 0").join(base, "query_id").select("query_id", "place", F.array_except("terms", "base").alias("terms"))
    parts = each.filter("place = 0").union(added).select(F.struct("query_id", "place").alias("q"), F.explode("terms").alias("term"))
    sums = cut(bm25_sums(table(spark, sf_dir, "documents"), parts, query_key="q").select("q.*", "doc_id", "sum"))
    whole = sums.filter("place = 0").select("query_id", "doc_id", F.col("sum").alias("base"))
    more = sums.filter("place > 0").join(whole, ["query_id", "doc_id"], "left").select("query_id", "place", "doc_id", (F.col("sum") + F.coalesce("base", F.lit(0.0))).alias("sum"))
    order = [F.round(-F.col("sum"), 9), F.col("doc_id")]
    first = top_k(whole.withColumnRenamed("base", "sum"), "query_id", order, DEPTH).drop("rank")
    rest = added.select("query_id", "place").join(first, "query_id").join(more.select("query_id", "place", "doc_id"), ["query_id", "place", "doc_id"], "left_anti")
    scored = first.withColumn("place", F.lit(0)).unionByName(more).unionByName(rest).select(F.struct("query_id", "place").alias("q"), "doc_id", "sum")
    ranked = top_k(scored, "q", order, DEPTH)
    place = F.col("q.place")
    merged = ranked.groupBy(F.col("q.query_id").alias("query_id"), "doc_id").agg(F.round(F.sum(1 / (F.lit(60) + F.col("rank"))), 12).alias("score"), F.min("rank").alias("best_rank"), F.count("*").alias("n_branches"), F.min_by(place, F.struct("rank", place)).alias("first_branch"))
    best = top_k(merged, "query_id", [F.desc("score"), F.col("best_rank"), F.desc("n_branches"), F.col("first_branch"), F.col("doc_id")], TOP)
    return best.withColumn("score", F.round("score", 9))


@query(
    f"""WITH t AS (SELECT DISTINCT unnest({STOPPED}) AS term FROM benchmark)
    SELECT term, array_to_string(list_transform(list_filter(list_zip([1, 2, 3], v), lambda x: list_position(v, x[2]) = x[1]), lambda x: x[2]), ' ') AS variants FROM (
      SELECT term, [CASE WHEN y THEN stem || 'ies' WHEN regexp_matches(term, '(s|x|z|ch|sh)$') THEN term || 'es' ELSE term || 's' END,
        CASE WHEN term LIKE '%e' THEN term || 'd' WHEN y THEN stem || 'ied' ELSE term || 'ed' END,
        CASE WHEN term LIKE '%e' AND term NOT LIKE '%ee' THEN stem ELSE term END || 'ing'] AS v
      FROM (SELECT term, substring(term, 1, length(term) - 1) AS stem, regexp_matches(term, '[b-df-hj-np-tv-xz]y$') AS y FROM t WHERE regexp_matches(term, '^[a-z][a-z0-9]*$')))"""
)
def morphology_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plural, past and gerund forms of every search term."""
    terms = search_terms(spark, sf_dir).select("term").distinct().filter(F.col("term").rlike("^[a-z][a-z0-9]*$"))
    return terms.select("term", F.array_join(variants(F.col("term")), " ").alias("variants"))


_TRIGGERS = ", ".join(f"('{f}', '{w}')" for f, (calls, _) in INTENTS.items() for w in calls)
_ADDED = ", ".join(f"('{f}', '{w}')" for f, (_, adds) in INTENTS.items() for w in adds)


@query(
    rf"""WITH trig(family, word) AS (VALUES {_TRIGGERS}), added(family, term) AS (VALUES {_ADDED}),
    turns AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM conversations),
    active AS (SELECT DISTINCT conv_id, turn, family FROM turns JOIN trig USING (word))
    SELECT conv_id, turn, count(DISTINCT a.family) AS n_families, string_agg(DISTINCT a.family, ',' ORDER BY a.family) AS families, count(DISTINCT CASE WHEN t.term IS NOT NULL THEN (a.family, t.term) END) AS n_added
    FROM conversations c LEFT JOIN active a USING (conv_id, turn) LEFT JOIN added t ON t.family = a.family GROUP BY conv_id, turn"""
)
def intent_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent families that each turn's words call (of repeated turns, those of any), and how many terms they add."""
    words = tokens(F.col("text"))
    calls = {f: F.coalesce(F.arrays_overlap(words, planning.literals(c)), F.lit(False)) for f, (c, _) in sorted(INTENTS.items())}
    found = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(*(F.bool_or(c).alias(f) for f, c in calls.items()))
    names = F.array_compact(F.array(*(F.when(F.col(f"`{f}`"), F.lit(f)) for f in calls)))
    added = sum((F.when(F.col(f"`{f}`"), len(INTENTS[f][1])).otherwise(0) for f in calls), F.lit(0))
    return found.select("conv_id", "turn", F.size(names).cast("long").alias("n_families"), F.when(F.size(names) > 0, F.array_join(names, ",")).alias("families"), added.cast("long").alias("n_added"))


@query(
    f"""WITH e AS (SELECT item_id, array_to_string(list_sort(list_distinct({STOPPED})), ' OR ') AS expression FROM benchmark)
    SELECT expression, min(item_id) AS item_id, count(*) - 1 AS n_aliases FROM e GROUP BY expression"""
)
def branch_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches with one expression are one branch; the others are its aliases."""
    e = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.sort_array(query_terms(F.col("text"))), " OR ").alias("expression"))
    return e.groupBy("expression").agg(F.min("item_id").alias("item_id"), (F.count("*") - 1).alias("n_aliases"))


_LANE = f"""
lane AS (SELECT s.item_id, s.doc_id, s.rank, s.doc_id % 4 AS slot, 4 * (s.doc_id % 4) < 4 AS early FROM semantic s),
aux AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM lane WHERE rank > {TOP} AND early)
"""


def _lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline (the first ranks) and auxiliary rows (later ones in the first quarter of their parent) in order."""
    ranked = semantic(spark, sf_dir).withColumn("slot", F.col("doc_id") % 4)
    later = ranked.filter((F.col("rank") > TOP) & (4 * F.col("slot") < 4))
    auxiliary = top_k(later.withColumnRenamed("rank", "r"), "item_id", [F.col("r")], 32).withColumnRenamed("rank", "place").withColumnRenamed("r", "rank")
    return ranked.filter(F.col("rank") <= TOP).withColumn("lane", F.lit("baseline")).withColumn("place", F.col("rank")).unionByName(auxiliary.withColumn("lane", F.lit("auxiliary")))


@query("WITH " + SEMANTIC_SQL + "," + _LANE + f"SELECT item_id, doc_id, rank, slot, 'baseline' AS lane, rank AS place FROM lane WHERE rank <= {TOP} UNION ALL SELECT item_id, doc_id, rank, slot, 'auxiliary', place::INT FROM aux WHERE place <= 32")
def positional_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline and the auxiliary lane of early spans."""
    return _lane(spark, sf_dir).select("item_id", "doc_id", "rank", "slot", "lane", "place")


@query("WITH " + SEMANTIC_SQL + "," + _LANE + "SELECT item_id, doc_id, rank AS chosen_rank, 'current' AS kind FROM lane WHERE rank <= 7 UNION ALL SELECT item_id, arg_min(doc_id, (slot, rank, doc_id)), arg_min(rank, (slot, rank, doc_id)), 'earliest' FROM aux WHERE place <= 32 GROUP BY item_id UNION ALL SELECT item_id, doc_id, rank, 'current' FROM lane WHERE rank = 8 AND item_id NOT IN (SELECT item_id FROM aux)")
def guarded_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven current rows and the earliest auxiliary one; eight current ones where there is no auxiliary."""
    lanes = cut(_lane(spark, sf_dir))
    current = lanes.filter("lane = 'baseline'").select("item_id", "doc_id", F.col("rank").alias("place"), "rank")
    return _selected(current, lanes).select("item_id", "doc_id", F.col("rank").alias("chosen_rank"), "kind")


def _selected(current: DataFrame, lanes: DataFrame) -> DataFrame:
    """``item_id, doc_id, place, rank, kind``: the first seven by ``place`` and the earliest auxiliary, or the first eight."""
    key = F.struct("slot", "rank", "doc_id")
    earliest = lanes.filter("lane = 'auxiliary'").groupBy("item_id").agg(F.min_by("doc_id", key).alias("doc_id"), F.min_by("rank", key).alias("rank"))
    first = current.join(earliest.select("item_id", F.lit(True).alias("has")), "item_id", "left").filter(F.col("place") <= F.when(F.col("has"), 7).otherwise(8))
    return first.select("item_id", "doc_id", "place", "rank", F.lit("current").alias("kind")).unionByName(earliest.select("item_id", "doc_id", F.lit(8).alias("place"), "rank", F.lit("earliest").alias("kind")))


@query(
    "WITH RECURSIVE "
    + LEXICAL_SQL
    + ","
    + SEMANTIC_SQL
    + ","
    + _LANE
    + f""", r AS (SELECT s.item_id, s.doc_id, s.rank AS a, coalesce(l.rank, 2147483647) AS b FROM semantic s LEFT JOIN lexical l ON l.item_id = s.item_id AND l.doc_id = s.doc_id WHERE s.rank <= {TOP}),
    dom AS (SELECT y.item_id, x.doc_id AS hi, y.doc_id AS lo FROM r x JOIN r y ON x.item_id = y.item_id AND x.a <= y.a AND x.b <= y.b AND (x.a < y.a OR x.b < y.b)),
    depth(item_id, doc_id, layer) AS (SELECT item_id, doc_id, 1 FROM r UNION SELECT d.item_id, d.lo, p.layer + 1 FROM depth p JOIN dom d ON d.item_id = p.item_id AND d.hi = p.doc_id),
    reranked AS (SELECT item_id, doc_id, a AS rank, row_number() OVER (PARTITION BY item_id ORDER BY layer, a, doc_id)::INT AS place FROM (SELECT item_id, doc_id, max(layer) AS layer FROM depth GROUP BY ALL) JOIN r USING (item_id, doc_id)),
    early AS (SELECT item_id, arg_min(doc_id, (slot, rank, doc_id)) AS doc_id, arg_min(rank, (slot, rank, doc_id)) AS rank FROM aux WHERE place <= 32 GROUP BY item_id)
    SELECT item_id, doc_id, place, rank, 'current' AS kind FROM reranked WHERE place <= CASE WHEN item_id IN (SELECT item_id FROM early) THEN 7 ELSE 8 END UNION ALL SELECT item_id, doc_id, 8, rank, 'earliest' FROM early"""
)
def rerank_and_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline lane by Pareto layers, its first eight, and the guarded selector over them."""
    lanes = cut(_lane(spark, sf_dir))
    baseline = lanes.filter("lane = 'baseline'").select("item_id", "doc_id", F.col("rank").alias("semantic_rank"))
    ranks = lexical(spark, sf_dir).select("item_id", "doc_id", F.col("rank").alias("lexical_rank"))
    layers = pareto_layers(baseline.join(ranks, ["item_id", "doc_id"], "left"), "item_id").join(baseline, ["item_id", "doc_id"])
    reranked = top_k(layers, "item_id", [F.col("layer"), F.col("semantic_rank"), F.col("doc_id")], TOP)
    return _selected(reranked.select("item_id", "doc_id", F.col("rank").alias("place"), F.col("semantic_rank").alias("rank")), lanes)


@query("WITH " + LEXICAL_SQL + f"SELECT item_id, least(count(*), {TOP}) AS n_returned, count(*) > {TOP} AS overflow FROM scored GROUP BY item_id")
def candidate_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a search has more hits than its limit: one row beyond the limit is read and tells."""
    read = lexical(spark, sf_dir, TOP + 1).groupBy("item_id").agg(F.count("*").alias("n"))
    return read.select("item_id", F.least("n", F.lit(TOP)).cast("long").alias("n_returned"), (F.col("n") > TOP).alias("overflow"))


@query(
    "WITH "
    + SEMANTIC_SQL
    + f""", one AS (SELECT item_id, list(doc_id ORDER BY rank) AS ids FROM semantic WHERE rank <= {TOP} GROUP BY item_id),
    two AS (SELECT item_id, list_transform(list_slice(list_sort(list({{'s': -score, 'd': doc_id}})), 1, {TOP}), lambda x: x.d) AS ids FROM cos_ GROUP BY item_id)
    SELECT item_id, len(list_intersect(one.ids, two.ids)) / len(one.ids)::DOUBLE AS recall, one.ids = two.ids AS same_order FROM one JOIN two USING (item_id)"""
)
def vector_block_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over two sizes of blocks: recall of one in the other, and whether the order is the same."""
    one = semantic(spark, sf_dir, TOP).select("item_id", "doc_id", "rank")
    two = semantic(spark, sf_dir, TOP, block=333).select("item_id", "doc_id", F.col("rank").alias("other"))
    return one.join(two, ["item_id", "doc_id"], "full_outer").groupBy("item_id").agg((F.count_if(F.col("rank").isNotNull() & F.col("other").isNotNull()) / F.count("rank")).alias("recall"), F.bool_and(F.col("rank").eqNullSafe(F.col("other"))).alias("same_order"))


@query(
    "WITH RECURSIVE "
    + LEXICAL_SQL
    + ","
    + SEMANTIC_SQL
    + """, r AS (SELECT s.item_id, s.doc_id, s.rank AS a, coalesce(l.rank, 2147483647) AS b FROM semantic s LEFT JOIN lexical l ON l.item_id = s.item_id AND l.doc_id = s.doc_id WHERE s.rank <= 20),
    dom AS (SELECT y.item_id, x.doc_id AS hi, y.doc_id AS lo FROM r x JOIN r y ON x.item_id = y.item_id AND x.a <= y.a AND x.b <= y.b AND (x.a < y.a OR x.b < y.b)),
    depth(item_id, doc_id, layer) AS (SELECT item_id, doc_id, 1 FROM r UNION SELECT d.item_id, d.lo, p.layer + 1 FROM depth p JOIN dom d ON d.item_id = p.item_id AND d.hi = p.doc_id)
    SELECT item_id, doc_id, max(layer)::INT AS layer FROM depth GROUP BY ALL"""
)
def pareto_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pareto layers of the twenty best vectors of each search by semantic and lexical rank."""
    best = semantic(spark, sf_dir, 20).select("item_id", "doc_id", F.col("rank").alias("semantic_rank"))
    ranks = lexical(spark, sf_dir).select("item_id", "doc_id", F.col("rank").alias("lexical_rank"))
    return pareto_layers(best.join(ranks, ["item_id", "doc_id"], "left"), "item_id")


#: Places where a passage may stand that are broadcast to the texts at most.
_MOST_PLACES = 400_000
_RELEVANT = f"rel AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(regexp_extract_all(lower(b.text), '{TOKEN}')) > 0)"


def passage_terms(passages: DataFrame) -> DataFrame:
    """``item_id, passage, n, inner``: a passage, how many tokens it has, and the different ones that every text around it has, too.

    Nothing around a passage can change its tokens but the first and the last.
    Where some of them are terms of the search, those are enough.
    """
    each = passages.select("item_id", F.col("text").alias("passage"), tokens(F.coalesce("text", F.lit(""))).alias("t"), query_terms(F.coalesce("text", F.lit(""))).alias("searched")).filter(F.size("t") > 0)
    inner = F.array_distinct(F.slice("t", F.lit(2), F.greatest(F.lit(0), F.size("t") - 2)))
    searched = F.array_intersect(inner, F.col("searched"))
    return each.select("item_id", "passage", F.size("t").alias("n"), F.when(F.size(searched) > 0, searched).otherwise(inner).alias("inner"))


def relevant(passages: DataFrame, documents: DataFrame, tf: DataFrame | None = None) -> DataFrame:
    """``item_id, doc_id``: a document (``doc_id, text``) is relevant to a search (``item_id, text``) if it holds the search's whole passage.

    A passage can only stand in documents that have the one of its inner tokens
    which the fewest documents have; their texts are compared in full. ``tf``
    are the counted occurrences of all inner tokens, if they are known already.
    Passages of one or two tokens have no inner ones; they are compared with
    every text where it is read. A passage without a token is judged by nothing.
    """
    each = passage_terms(passages)
    terms = each.filter("n > 2").select("item_id", F.explode("inner").alias("term"))
    tf = counted(documents, terms) if tf is None else tf
    sizes = tf.filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    rarest = terms.join(sizes, "term", "left").groupBy("item_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    places = cut(tf.filter("term <> ''").join(rarest, "term").select("doc_id", "item_id"))
    places = F.broadcast(places) if places.count() <= _MOST_PLACES else places
    met = documents.join(places, "doc_id").join(each.select("item_id", "passage"), "item_id")
    found = met.filter(F.contains("text", "passage")).select("item_id", "doc_id")
    short = each.filter("n <= 2").select("item_id", "passage")
    if short.isEmpty():
        return found.distinct()
    # The stated searches of one or two tokens, in one array that every text meets where it is read.
    stated = short.agg(F.collect_list(F.struct("item_id", "passage"))).scalar()
    direct = documents.filter("text IS NOT NULL").withColumn("stated", stated).select("doc_id", F.explode(F.filter("stated", lambda p: F.contains(F.col("text"), p["passage"]))).alias("p"))
    return found.union(direct.select("p.item_id", "doc_id")).distinct()


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lexical channel and what is relevant, from one pass over the texts."""
    documents, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    searches = search_terms(spark, sf_dir)
    inner = passage_terms(passages).filter("n > 2").select(F.explode("inner").alias("term"))
    tf = counted(documents, searches.select("term").union(inner))
    scored = counted_sums(tf, searches, query_key="item_id").select("item_id", "doc_id", F.round(-F.col("sum"), 9).alias("score"))
    return cut(top_k(scored, "item_id", [F.col("score"), F.col("doc_id")], DEPTH)), cut(relevant(passages, documents.select("doc_id", "text"), tf))


@query(
    "WITH "
    + LEXICAL_SQL
    + ","
    + _RELEVANT
    + f""", h AS (SELECT item_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM lexical JOIN rel USING (item_id, doc_id) WHERE rank <= {TOP} GROUP BY item_id),
    n AS (SELECT item_id, count(*) AS n FROM rel GROUP BY item_id), k AS (SELECT item_id FROM lexical UNION SELECT item_id FROM rel)
    SELECT item_id, CASE WHEN n IS NOT NULL THEN round(coalesce(hits, 0) / n, 6) END AS recall, CASE WHEN n IS NOT NULL THEN round(coalesce(1 / first, 0), 6) END AS reciprocal_rank,
      CASE WHEN n IS NOT NULL THEN round(coalesce(gain, 0) / list_sum(list_transform(range(1, least(n, {TOP}) + 1), lambda i: 1 / log2(i + 1))), 6) END AS ndcg
    FROM k LEFT JOIN n USING (item_id) LEFT JOIN h USING (item_id)"""
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and nDCG at ten of the lexical channel for each search."""
    return ranking_metrics(*_judged(spark, sf_dir), "item_id", TOP)


@query(
    "WITH "
    + LEXICAL_SQL
    + ","
    + SEMANTIC_SQL
    + ","
    + FUSED_SQL
    + ","
    + _RELEVANT
    + f""", ranked AS (SELECT 'lexical' AS channel, item_id, doc_id, rank FROM lexical UNION ALL SELECT 'semantic', item_id, doc_id, rank FROM semantic UNION ALL SELECT 'fused', item_id, doc_id, fused_rank FROM fused),
    h AS (SELECT channel, item_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM ranked JOIN rel USING (item_id, doc_id) WHERE rank <= {TOP} GROUP BY ALL),
    n AS (SELECT channel, item_id, n FROM (SELECT item_id, count(*) AS n FROM rel GROUP BY item_id), (SELECT DISTINCT channel FROM ranked))
    SELECT channel, count(*) AS n_scored, round(avg(coalesce(hits, 0) / n), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(gain, 0) / list_sum(list_transform(range(1, least(n, {TOP}) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg
    FROM n LEFT JOIN h USING (channel, item_id) GROUP BY channel"""
)
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages of each channel and their fusion over the searches for which something is relevant."""
    first, wanted = _judged(spark, sf_dir)
    found = cut(fused(spark, sf_dir, first))
    channels = {"lexical": "lexical_rank", "semantic": "semantic_rank", "fused": "fused_rank"}
    ranked = None
    for name, rank in channels.items():
        rows = found.filter(F.col(rank).isNotNull()).select(F.struct(F.lit(name).alias("channel"), "item_id").alias("key"), "doc_id", F.col(rank).alias("rank"))
        ranked = rows if ranked is None else ranked.union(rows)
    wanted = wanted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col("item_id")) for c in channels))).alias("key"), "doc_id")
    scored = ranking_metrics(ranked, wanted, "key", TOP, places=12).filter("recall IS NOT NULL")
    return scored.groupBy("key.channel").agg(F.count("*").alias("n_scored"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query(
    "WITH "
    + LEXICAL_SQL
    + ","
    + SEMANTIC_SQL
    + """, l AS (SELECT DISTINCT item_id, doc_id FROM lexical), v AS (SELECT DISTINCT item_id, doc_id FROM semantic)
    SELECT 'overlap' AS part, count(*) AS n FROM (SELECT * FROM l INTERSECT SELECT * FROM v) UNION ALL SELECT 'lexical only', count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM v) UNION ALL SELECT 'semantic only', count(*) FROM (SELECT * FROM v EXCEPT SELECT * FROM l)"""
)
def channel_complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that both channels gave, or one alone, as set operations."""
    a = lexical(spark, sf_dir).select("item_id", "doc_id")
    b = semantic(spark, sf_dir).select("item_id", "doc_id")
    parts = {"overlap": a.intersect(b), "lexical only": a.subtract(b), "semantic only": b.subtract(a)}
    out = None
    for name, rows in parts.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.union(n)
    return out

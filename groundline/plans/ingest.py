"""Queries of the ingest chain: normalising, words, pages, chunks, spans, identities, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.functions.text import TOKEN, WHITE, collapse, content_id, normalized, quality, tokens, words
from groundline.operators.ingest import PAGE_WORDS, budget_spans, chunks, let, pages, running_sums
from groundline.plans.registry import query
from groundline.sources.tables import table

#: SQL of the canonical text and its pages, in DuckDB's own words.
CANON = rf"trim(regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g'))"
PAGES_SQL = f"""
canon AS (SELECT doc_id, source, list_filter(string_split({CANON}, ' '), lambda w: w <> '') AS w FROM documents),
pages_ AS (
  SELECT doc_id, source, i AS page_index, w[i * {PAGE_WORDS} + 1 : (i + 1) * {PAGE_WORDS}] AS page_words
  FROM (SELECT doc_id, source, w, unnest(range(greatest(1, ceil(len(w) / {PAGE_WORDS}.0)::BIGINT))) AS i FROM canon)
),
"""
CHUNKS_SQL = (
    "WITH RECURSIVE "
    + PAGES_SQL
    + r"""
cuts AS (
  SELECT doc_id, source, page_index, page_words, 0::BIGINT AS ordinal, 0::BIGINT AS start_word,
         CASE WHEN len(page_words) <= 120 THEN len(page_words) ELSE coalesce(list_max(list_filter(range(90, 121), lambda i: regexp_matches(page_words[i], '[.?!][")]?$'))), 120) END AS end_word
  FROM pages_ WHERE len(page_words) >= 3 AND length(array_to_string(page_words, ' ')) >= 24
  UNION ALL
  SELECT doc_id, source, page_index, page_words, ordinal + 1, end_word,
         CASE WHEN len(page_words) - end_word <= 120 THEN len(page_words) ELSE end_word + coalesce(list_max(list_filter(range(90, 121), lambda i: regexp_matches(page_words[end_word + i], '[.?!][")]?$'))), 120) END
  FROM cuts WHERE end_word < len(page_words)
),
chunks_ AS (
  SELECT doc_id, source, page_index, ordinal, start_word, end_word - start_word AS n_words,
         CASE WHEN start_word = 0 THEN 0 ELSE length(array_to_string(page_words[1:start_word], ' ')) + 1 END AS start_offset,
         array_to_string(page_words[start_word + 1 : end_word], ' ') AS chunk_text
  FROM cuts
)
"""
)


@query(f"SELECT doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '{WHITE}', ' ', 'g')) AS canonical_text FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFC and collapsed white space."""
    return normalized(table(spark, sf_dir, "documents"), "text", "canonical_text").select("doc_id", "canonical_text")


@query(
    "WITH "
    + PAGES_SQL.rstrip().rstrip(",")
    + """
SELECT doc_id, page_index::INT AS page_index, q AS quality, q <> 'adequate' AS needs_ocr FROM (
  SELECT doc_id, page_index, CASE WHEN length(t) = 0 THEN 'empty' WHEN n < 3 OR length(t) < 24 THEN 'low' ELSE 'adequate' END AS q
  FROM (SELECT doc_id, page_index, len(page_words) AS n, array_to_string(page_words, ' ') AS t FROM pages_))"""
)
def text_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality class of every page; pages that are not adequate need another reading."""
    q = quality(F.col("page_text"), F.size("page_words"))
    return pages(table(spark, sf_dir, "documents")).select("doc_id", "page_index", q.alias("quality"), (q != "adequate").alias("needs_ocr"))


@query(
    f"""
SELECT doc_id, word_index::INT AS word_index, word, (sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY word_index) - length(word) - 1)::INT AS char_start
FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS word_index
      FROM (SELECT doc_id, list_filter(string_split({CANON}, ' '), lambda x: x <> '') AS w FROM documents))"""
)
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its place in the canonical text, by running sums within its row: no text leaves it."""
    placed = lambda w: F.zip_with(w, running_sums(F.transform(w, lambda x: F.length(x) + 1)), lambda x, at: F.struct(x.alias("word"), at.alias("char_start")))
    docs = table(spark, sf_dir, "documents").select("doc_id", let(words(collapse(F.col("text"))), placed).alias("p"))
    return docs.select("doc_id", F.posexplode_outer("p").alias("word_index", "x")).filter("x IS NOT NULL").select("doc_id", "word_index", "x.*")


@query(
    "WITH "
    + PAGES_SQL.rstrip().rstrip(",")
    + """
, t AS (SELECT doc_id, page_index, length(array_to_string(page_words, ' ')) AS len FROM pages_)
SELECT doc_id, page_index::INT AS page_index, len::INT AS page_length,
       coalesce(sum(len + 1) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_base,
       (sum(len) OVER (PARTITION BY doc_id) + count(*) OVER (PARTITION BY doc_id) - 1)::BIGINT AS document_length FROM t"""
)
def page_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page starts in its document, and the document's length, separators included."""
    sized = pages(table(spark, sf_dir, "documents")).select("doc_id", "page_index", F.length("page_text").alias("page_length"))
    doc = Window.partitionBy("doc_id")
    before = doc.orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.col("page_length") + 1).over(before), F.lit(0))
    return sized.withColumn("page_base", base.cast("long")).withColumn("document_length", (F.sum("page_length").over(doc) + F.count("*").over(doc) - 1).cast("long"))


@query(CHUNKS_SQL + "SELECT doc_id, page_index::INT AS page_index, ordinal::INT AS ordinal, start_word::INT AS start_word, n_words::INT AS n_words, start_offset::INT AS start_offset, (start_offset + length(chunk_text))::INT AS end_offset, chunk_text FROM chunks_")
def chunks_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy chunks of every page, cut after a sentence end where there is one late enough; pages that need another reading give none."""
    return chunks(pages(table(spark, sf_dir, "documents"))).drop("source")


@query(
    "WITH RECURSIVE "
    + PAGES_SQL
    + """
fold AS (
  SELECT doc_id, page_index, page_words, 0::BIGINT AS i, 0::BIGINT AS open, 0::BIGINT AS used, NULL::STRUCT(s BIGINT, e BIGINT, ok BOOLEAN)[] AS made FROM pages_ WHERE len(page_words) > 0
  UNION ALL
  SELECT doc_id, page_index, page_words, i + 1,
    CASE WHEN c > 64 THEN i + 1 WHEN used + c <= 64 THEN open ELSE i END,
    CASE WHEN c > 64 THEN 0 WHEN used + c <= 64 THEN used + c ELSE c END,
    CASE WHEN c > 64 THEN (CASE WHEN i > open THEN [{'s': open, 'e': i, 'ok': true}, {'s': i, 'e': i + 1, 'ok': false}] ELSE [{'s': i, 'e': i + 1, 'ok': false}] END)
         WHEN used + c <= 64 THEN NULL WHEN i > open THEN [{'s': open, 'e': i, 'ok': true}] END
  FROM (SELECT *, ceil(length(page_words[i + 1]) / 4.0)::BIGINT AS c FROM fold WHERE i < len(page_words))
),
spans AS (
  SELECT doc_id, page_index, unnest(made) AS x FROM fold WHERE made IS NOT NULL
  UNION ALL
  SELECT doc_id, page_index, {'s': open, 'e': i, 'ok': true} FROM fold WHERE i = len(page_words) AND i > open
)
SELECT doc_id, page_index::INT AS page_index, x.s::INT AS start_word, x.e::INT AS end_word, CASE WHEN x.ok THEN 'EMBEDDABLE' ELSE 'EXCLUDED_UNEMBEDDABLE' END AS coverage_status FROM spans"""
)
def spans_greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy spans within a token budget; four characters stand for a token."""
    spans = budget_spans(F.col("page_words"), lambda w: F.ceil(F.length(w) / 4).cast("int"), 64)
    each = pages(table(spark, sf_dir, "documents")).select("doc_id", "page_index", F.explode(spans).alias("x"))
    status = F.when(F.col("x.ok"), "EMBEDDABLE").otherwise("EXCLUDED_UNEMBEDDABLE")
    return each.select("doc_id", "page_index", F.col("x.s").alias("start_word"), F.col("x.e").alias("end_word"), status.alias("coverage_status"))


_FRAME = "unhex(lpad(hex(octet_length(encode({0}))), 16, '0')) || encode({0})"


@query(
    f"""SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
    'file-version-sha256-' || sha256({_FRAME.format("doc_id::VARCHAR")} || {_FRAME.format("sha256(coalesce(text, ''))")}) AS file_version_id FROM documents"""
)
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed identities over length-prefixed parts."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return table(spark, sf_dir, "documents").select("doc_id", digest.alias("text_sha256"), content_id("file-version-sha256-", F.col("doc_id").cast("string"), digest).alias("file_version_id"))


@query(
    CHUNKS_SQL
    + f""", k AS (SELECT doc_id, page_index, ordinal, start_offset, start_offset + length(chunk_text) AS end_offset, sha256(chunk_text) AS digest FROM chunks_)
    SELECT doc_id, page_index::INT AS page_index, ordinal::INT AS ordinal, 'page-sha256-' || sha256({_FRAME.format("doc_id::VARCHAR")} || {_FRAME.format("page_index::VARCHAR")}) AS page_id,
      'chunk-sha256-' || sha256({_FRAME.format("doc_id::VARCHAR")} || {_FRAME.format("page_index::VARCHAR")} || {_FRAME.format("start_offset::VARCHAR")} || {_FRAME.format("end_offset::VARCHAR")} || {_FRAME.format("digest")}) AS chunk_id FROM k"""
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed identities of pages and chunks: the same text at the same place has the same one."""
    return identified(chunks(pages(table(spark, sf_dir, "documents")))).select("doc_id", "page_index", "ordinal", "page_id", "chunk_id")


def identified(chunk_rows: DataFrame) -> DataFrame:
    """Adds ``page_id`` and ``chunk_id``."""
    text = lambda c: F.col(c).cast("string")
    page = content_id("page-sha256-", text("doc_id"), text("page_index"))
    chunk = content_id("chunk-sha256-", text("doc_id"), text("page_index"), text("start_offset"), text("end_offset"), F.sha2("chunk_text", 256))
    return chunk_rows.withColumn("page_id", page).withColumn("chunk_id", chunk)


@query(
    CHUNKS_SQL
    + f"""SELECT doc_id, page_index::INT AS page_index, word_index::INT AS word_index, 'anchor-sha256-' || sha256({_FRAME.format("doc_id::VARCHAR")} || {_FRAME.format("page_index::VARCHAR")} || {_FRAME.format("word_index::VARCHAR")} || {_FRAME.format("word")}) AS anchor_id
    FROM (SELECT doc_id, page_index, unnest(page_words) AS word, generate_subscripts(page_words, 1) - 1 AS word_index FROM pages_)"""
)
def anchor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed identities of anchors: a word at its place in a page."""
    each = pages(table(spark, sf_dir, "documents")).select("doc_id", "page_index", F.posexplode_outer("page_words").alias("word_index", "word")).filter("word IS NOT NULL")
    text = lambda c: F.col(c).cast("string")
    return each.select("doc_id", "page_index", "word_index", content_id("anchor-sha256-", text("doc_id"), text("page_index"), text("word_index"), F.col("word")).alias("anchor_id"))


@query(
    """WITH d AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS digest FROM documents),
    old AS (SELECT DISTINCT source, digest FROM d WHERE doc_id % 2 = 0)
    SELECT d.source, d.digest, min(d.doc_id) AS first_doc_id, count(*) AS n_offered FROM d ANTI JOIN old ON d.source = old.source AND d.digest = old.digest GROUP BY ALL"""
)
def dedupe_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission by digest: odd documents whose text no even document of the source has, each text once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    # One aggregation: copies are combined in their tasks, and nothing is joined.
    old = F.bool_or(F.col("doc_id") % 2 == 0)
    return docs.groupBy("source", "digest").agg(old.alias("known"), F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n_offered")).filter("NOT known").drop("known")


@query(
    """WITH needle AS (SELECT unnest(['the the', 'que la', 'der die', 'anan']) AS needle),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    per_line AS (SELECT doc_id, needle, len(list_filter(range(1, length(line) - length(needle) + 2), lambda i: substring(line, i, length(needle)) = needle)) AS n FROM lines, needle WHERE contains(line, needle)),
    t AS (SELECT doc_id, needle, sum(n)::BIGINT AS n_places FROM per_line GROUP BY ALL)
    SELECT doc_id, needle, n_places, CASE WHEN n_places = 1 THEN instr(text, needle) - 1 END AS char_start, CASE n_places WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome FROM t JOIN documents USING (doc_id)"""
)
def anchor_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of fixed phrases, overlapping ones included: one place is an anchor, more are ambiguous."""
    needles = ("the the", "que la", "der die", "anan")
    docs = table(spark, sf_dir, "documents")
    each = docs.select("doc_id", "text", F.explode(F.array(*map(F.lit, needles))).alias("needle")).filter(F.contains("text", "needle"))
    places = F.regexp_count("text", F.concat(F.lit("(?="), F.col("needle"), F.lit(")"))).cast("long")
    one = F.col("n_places") == 1
    return each.select("doc_id", "needle", places.alias("n_places"), F.instr(F.col("text"), F.col("needle")).alias("at")).select("doc_id", "needle", "n_places", F.when(one, F.col("at") - 1).cast("long").alias("char_start"), F.when(one, "found").otherwise("ambiguous").alias("outcome"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, CASE WHEN count(*) FILTER (regexp_matches(line, '^[A-Z][a-z]+\\.$')) = 1 THEN max(line) FILTER (regexp_matches(line, '^[A-Z][a-z]+\\.$')) END AS printed_label FROM l GROUP BY doc_id"""
)
def printed_label_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of the label's form if a document has exactly one, else none."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^[A-Z][a-z]+\.$"))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", lines.alias("labels"))
    return docs.select("doc_id", F.when(F.size("labels") == 1, F.get("labels", F.lit(0))).alias("printed_label"))


@query(rf"SELECT token, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_documents FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM documents) GROUP BY token")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with its frequencies."""
    # The outer explode spares a second tokenising in a filter that Spark would infer.
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(tokens(F.col("text"))).alias("token")).filter("token IS NOT NULL")
    # Counting within documents first keeps the second shuffle free of repeats.
    per_doc = each.groupBy("token", "doc_id").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("token").agg(F.sum("tf").alias("n_occurrences"), F.count("*").alias("n_documents"))


@query(rf"SELECT source, count(*) AS n_documents, sum(len(regexp_extract_all(lower(text), '{TOKEN}')))::BIGINT AS n_tokens, round(avg(len(regexp_extract_all(lower(text), '{TOKEN}'))), 6) AS mean_length FROM documents GROUP BY source")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and mean length of each source."""
    docs = table(spark, sf_dir, "documents").select("source", F.size(tokens(F.col("text"))).alias("n"))
    return docs.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("mean_length"))


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))::INT AS text_length, CASE WHEN length(html) = 0 THEN 'empty' ELSE 'markup' END AS kind FROM pages")
def page_text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of raw pages, by removing scripts, styles, comments and tags."""
    bare = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    text = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).alias("text_length"), F.when(F.length("html") == 0, "empty").otherwise("markup").alias("kind"))

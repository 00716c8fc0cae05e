"""Text expressions: normalisation, words, tokens, identifiers, morphology. All are built-in functions but nfc()."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space by Unicode, as code points. Fixed values.
WHITE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: A letter or number, then letters, numbers and marks.
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
#: English function words that say nothing about a topic. Fixed values.
STOP_WORDS = (
    "a an the what which who whom whose when where why how is are was were be been being do does did "
    "this that these those of to in on at for and or"
).split()
#: Intent families: the words that call one, and the words that it adds. Fixed values.
INTENTS = {
    "research-objective-v1": (
        "aim objective purpose goal investigate examine evaluate assess determine".split(),
        "aim objective purpose goal investigate examine evaluate assess".split(),
    ),
    "research-method-v1": (
        "method methods approach procedure protocol design analysis".split(),
        "method approach procedure protocol design analysis technique experiment".split(),
    ),
    "research-result-v1": (
        "result results finding findings outcome effect conclusion".split(),
        "result finding outcome effect conclusion observation association change".split(),
    ),
}
#: A word that ends a sentence.
SENTENCE_END = r"[.?!][\")]?$"


def collapse(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "))


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode's composed form. Only texts with characters that can compose leave the JVM."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def normalized(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds NFC text with collapsed white space."""
    return df.withColumn(out, collapse(nfc(F.col(column))))


def words(canonical: Column) -> Column:
    """Words of a canonical text; none for the empty one."""
    return F.array_remove(F.split(canonical, " "), "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def query_terms(text: Column) -> Column:
    """Ordered distinct terms of a question without function words; only A-Z is lower-cased."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_except(F.regexp_extract_all(lower, F.lit(TOKEN), 0), F.array(*map(F.lit, STOP_WORDS)))


def content_id(prefix: str, *parts: Column) -> Column:
    """SHA-256 over length-prefixed UTF-8 parts, so no two lists of parts give one input."""
    framed = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), F.encode(p, "UTF-8")) for p in parts]
    return F.concat(F.lit(prefix), F.sha2(F.concat(*framed), 256))


def quality(text: Column, n_words: Column) -> Column:
    """empty; low (under 3 words or 24 characters); adequate."""
    return F.when(F.length(text) == 0, "empty").when((n_words < 3) | (F.length(text) < 24), "low").otherwise("adequate")


def variants(term: Column) -> Column:
    """Plural, past and gerund forms of a lower-case ASCII term, without repeats."""
    stem = F.substring(term, F.lit(1), F.length(term) - 1)
    consonant_y = term.rlike("[b-df-hj-np-tv-xz]y$")
    plural = F.when(consonant_y, F.concat(stem, F.lit("ies"))).when(term.rlike("(s|x|z|ch|sh)$"), F.concat(term, F.lit("es"))).otherwise(F.concat(term, F.lit("s")))
    past = F.when(term.endswith("e"), F.concat(term, F.lit("d"))).when(consonant_y, F.concat(stem, F.lit("ied"))).otherwise(F.concat(term, F.lit("ed")))
    gerund = F.concat(F.when(term.endswith("e") & ~term.endswith("ee"), stem).otherwise(term), F.lit("ing"))
    return F.when(term.rlike("^[a-z][a-z0-9]*$"), F.array_distinct(F.array(plural, past, gerund))).otherwise(F.array().cast("array<string>"))

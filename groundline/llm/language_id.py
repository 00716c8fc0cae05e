"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree: for every context of up to
``order`` bytes seen in training, how often each byte followed. A byte's code
length is found at the longest context in which the language has seen it, plus
the escapes from the longer contexts it has seen (an escape has the weight of
the number of different followers), down to a uniform byte. The statistics are
frozen after training, so the code length of a whole text is exact and is a
sum over its bytes. The language with the shortest code wins.

Training takes a bounded sample of labelled rows (``per_cell`` documents in
each of 64 hash cells per language, each whole); its counts are summed by
Spark. Every language is learned, with all its runs. Languages are dealt into
groups whose tables have at most ``max_cells`` numbers, so no matter how many
there are, the driver and a worker hold one group's tables at a time. Every
text is scored whole. Code lengths are exact but for the rounding of floats.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut
from .repeats import _among

CELLS = 64


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """Each run of ``width`` bytes as one number, oldest byte first."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out << np.uint64(8) | data[k : n + k].astype(np.uint64)
    return out


class Level:
    """The runs of one width that any language has seen, with a row of code lengths for each."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self.keys, self.rows = keys, np.vstack([rows, np.zeros((1, rows.shape[1]))]).astype(np.float32)
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        # A table of hash slots; the few keys that lose their slot are found by binary search.
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)
        self.lost = np.flatnonzero(self.slots[self._slot(keys)] != np.arange(len(keys)))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; the last row (zeros) for keys not there."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int32)
        at = self.slots[self._slot(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        at = at.copy()
        at[miss] = len(self.keys)
        if len(self.lost) and len(miss):
            lost_keys = self.keys[self.lost]
            place = np.minimum(np.searchsorted(lost_keys, keys[miss]), len(lost_keys) - 1)
            hit = lost_keys[place] == keys[miss]
            at[miss[hit]] = self.lost[place[hit]]
        return at


class PpmModel:
    """Code lengths in bits by language, from counts ``(lang, width, gram, n)``."""

    def __init__(self, langs: list[str], order: int, lang: np.ndarray, width: np.ndarray, gram: np.ndarray, n: np.ndarray) -> None:
        self.langs, self.order = langs, order
        count = len(langs)
        self.levels: list[Level] = []  # of runs: context and byte
        self.escapes: list[Level] = []  # of contexts
        for w in range(1, order + 2):
            mine = width == w
            keys, row = np.unique(gram[mine], return_inverse=True)
            counts = np.zeros((len(keys), count))
            np.add.at(counts, (row, lang[mine]), n[mine])
            contexts, context_of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, followers = np.zeros((len(contexts), count)), np.zeros((len(contexts), count))
            np.add.at(total, context_of, counts)
            np.add.at(followers, context_of, counts > 0)
            whole = total + followers
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(followers / whole), 0.0)
                direct = -np.log2(counts / whole[context_of])
            # Where a language has not seen the run, it escapes to the next shorter context.
            shorter = self.bits(keys & np.uint64((1 << 8 * (w - 1)) - 1), w - 1)
            self.levels.append(Level(keys, np.where(counts > 0, direct, escape[context_of] + shorter)))
            self.escapes.append(Level(contexts, escape))

    def bits(self, keys: np.ndarray, width: int) -> np.ndarray:
        """The code length of the last byte of each run of ``width`` bytes, by language."""
        if width == 0:
            return np.full((len(keys), len(self.langs)), 8.0, dtype=np.float32)
        level = self.levels[width - 1]
        at = level.find(keys)
        out = level.rows[at]
        unseen = np.flatnonzero(at == len(level.keys))
        if len(unseen):
            rest = keys[unseen]
            escapes = self.escapes[width - 1]
            context = escapes.find(rest >> np.uint64(8))
            out[unseen] = escapes.rows[context] + self.bits(rest & np.uint64((1 << 8 * (width - 1)) - 1), width - 1)
        return out

    def code_length(self, data: bytes, block: int = 1 << 16) -> np.ndarray:
        """Bits of a whole text by language; the first bytes have shorter contexts."""
        x = np.frombuffer(data, dtype=np.uint8)
        total = np.zeros(len(self.langs))
        for w in range(1, min(self.order, len(x)) + 1):
            total += self.bits(grams(x[:w], w), w)[0]
        for at in range(0, len(x) - self.order, block):
            total += self.bits(grams(x[at : at + block + self.order], self.order + 1), self.order + 1).sum(axis=0, dtype=np.float64)
        return total

    def best(self, data: bytes) -> tuple[float, str, float]:
        """Bits and name of the shortest code, and the sum of all languages' probabilities in units of that one's."""
        length = self.code_length(data)
        best = int(np.argmin(length))
        return float(length[best]), self.langs[best], float(np.exp2(np.maximum(length[best] - length, -1000.0)).sum())

    def predict(self, data: bytes) -> tuple[str, float]:
        """The language of the shortest code, and its share of the languages' joint probability."""
        length = self.code_length(data)
        best = int(np.argmin(length))
        return self.langs[best], float(1.0 / np.exp2(np.maximum(length[best] - length, -1000.0)).sum())


def _count_grams(order: int):
    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer((text or "").encode(), dtype=np.uint8)
                for w in range(1, order + 2):
                    keys, n = np.unique(grams(x, w), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), w), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "width", "gram", "n"])

    return counted


def training_counts(documents: DataFrame, order: int = 3, per_cell: int = 4) -> DataFrame:
    """``lang, width, gram, n`` over a bounded sample of the rows with a language: ``64 * per_cell`` documents of each."""
    labelled = documents.filter("lang IS NOT NULL").select("doc_id", "lang", F.xxhash64(F.col("doc_id")).alias("h")).withColumn("cell", F.pmod("h", F.lit(CELLS)))
    order_in = Window.partitionBy("lang", "cell").orderBy("h", "doc_id")
    chosen = cut(labelled.withColumn("place", F.row_number().over(order_in)).filter(F.col("place") <= per_cell).select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("sample_lang")).distinct())
    # The ids of some hundred languages are small enough to broadcast; beyond, a filter of fixed size spares most texts the shuffle.
    few = chosen.count() <= 100_000
    known = F.broadcast(chosen) if few else chosen
    texts = documents if few else documents.filter(_among(F.col("doc_id"), chosen.select(F.col("sample_id").alias("row"))))
    sample = texts.join(known, (F.col("doc_id") == F.col("sample_id")) & (F.col("lang") == F.col("sample_lang"))).select("lang", "text")
    return sample.mapInArrow(_count_grams(order), "lang string, width int, gram long, n long").groupBy("lang", "width", "gram").agg(F.sum("n").alias("n"))


def _model(counts: DataFrame, order: int) -> PpmModel:
    found = counts.toArrow()
    codes = found.column("lang").combine_chunks().dictionary_encode() if found.num_rows else None
    names = codes.dictionary.to_pylist() if codes else []
    langs = sorted(names)
    place = np.array([langs.index(x) for x in names], dtype=np.int64)
    lang = place[codes.indices.to_numpy()] if codes else np.zeros(0, dtype=np.int64)
    return PpmModel(langs, order, lang, found.column("width").to_numpy(), found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy())


def fit(documents: DataFrame, *, order: int = 3, per_cell: int = 4) -> PpmModel:
    """One model of all languages; ``identify`` holds a group of them at a time."""
    return _model(training_counts(documents, order, per_cell), order)


def language_groups(sizes: list[tuple[str, int]], max_cells: int) -> list[list[str]]:
    """Deals languages (with the number of their runs), by name, into groups of ``max_cells`` table cells at most, or of one language."""
    groups, runs = [], 0
    for lang, n in sorted(sizes):
        if not groups or (runs + n) * (len(groups[-1]) + 1) > max_cells:
            groups.append([])
            runs = 0
        groups[-1].append(lang)
        runs += n
    return groups


def identify(documents: DataFrame, training: DataFrame, *, order: int = 3, per_cell: int = 4, max_cells: int = 4_000_000) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``documents``.

    ``training`` has ``doc_id, lang, text``. A null or empty text, or one
    without a letter, is ``und`` with score 0, as is everything when nothing
    could be learned. Of languages with equal code lengths the first by name
    wins. Texts of any length are scored whole; an empty table gives an empty
    result; repeated rows stay; other columns are ignored.
    """
    counts = cut(training_counts(training.select("doc_id", "lang", "text"), order, per_cell))
    sizes = [(r["lang"], r["n"]) for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    context = documents.sparkSession.sparkContext
    groups = [context.broadcast(cloudpickle.dumps(_model(counts.filter(F.col("lang").isin(langs)), order))) for langs in language_groups(sizes, max_cells)]

    def merged(one: tuple[float, str, float], two: tuple[float, str, float]) -> tuple[float, str, float]:
        """The better of two groups' results; ``one`` comes first by name."""
        (low, name, here), (high, _, there) = (two, one) if two[0] < one[0] else (one, two)
        return low, name, here + there * 2.0 ** max(low - high, -1000.0)

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pickle.loads(groups[0].value) if len(groups) == 1 else None
        for batch in it:
            best: list[tuple[float, str, float] | None] = [None] * batch.num_rows
            for group in groups:
                # One of several groups is read for a batch and forgotten.
                ppm = one or pickle.loads(group.load_from_path(group._path) if group._path else group.value)
                for k, value in enumerate(batch.column(1)):
                    text = value.as_py() or ""
                    if any(map(str.isalpha, text)):
                        found = ppm.best(text.encode())
                        best[k] = merged(best[k], found) if best[k] else found
            langs, scores = [x[1] if x else "und" for x in best], [1.0 / x[2] if x else 0.0 for x in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))

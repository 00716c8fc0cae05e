"""Toxicity of texts: a learned lexicon, met by Levenshtein automata, weighed by the context of each hit.

*Lexicon.* Words, and stems (the first four to eight letters, written ``stem*``)
with any ending, that stand in toxic documents of the labelled sample far more
often than in clean ones, by a likelihood ratio that allows for the number of
words tried. Near copies count once, so that the words of one copied text do
not pass for a rule.

*Matching.* The whole words make a trie. A token is run through the trie
intersected with the Levenshtein automaton: a state is a set of (trie node,
edits so far), made when it is first met and kept as a deterministic automaton.
Short words allow no edit, longer ones one or two; stems allow none, but the
words of the sample that begin with one are words of the trie, too.

*Context.* A hit is quoted (quotation marks around it within the window, or a
word of reporting before it there) or not, and near another hit or not. The
log-odds of each kind of hit are learned from the sample, shrunk to the belief
that quotations are weaker evidence. A document's score is a logistic function
of the evidence of its hits, fitted on the sample and set to the share of toxic
documents among all labelled ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CELLS = 64
WINDOW = 6
#: Letters of a stem.
STEMS = range(4, 9)
#: Words that announce somebody else's words. Fixed values.
REPORTING = frozenset("said says say saying called calls wrote writes quote quoted quotes quoting reads reported reporting word words term dit dijo dice sagt sagte schrieb nannte".split())
_MARKS = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}
_PIECE = re.compile(r"[^\W_]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_OTHER = "\0"
#: Kinds of hit: edits (0, 1, 2), quoted or not, alone in its window or not.
KINDS = 12


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """Finds the term nearest to a token, within the term's edits: a trie and Levenshtein automata, made deterministic as they are used."""

    def __init__(self, terms: list[str], most_states: int = 50_000, most_tokens: int = 100_000) -> None:
        self.terms, self.most_states, self.most_tokens = terms, most_states, most_tokens
        self.stems = {t[:-1]: k for k, t in enumerate(terms) if t.endswith("*")}
        self.stem_sizes = sorted({len(t) for t in self.stems}, reverse=True)
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int | None] = [None]
        self.left = [-1]  # the edits that some term below allows
        for k, term in enumerate(terms):
            if term.endswith("*"):
                continue
            node = 0
            for c in term:
                self.left[node] = max(self.left[node], allowed_edits(term))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(None)
                    self.left.append(-1)
                node = self.children[node][c]
            self.left[node] = max(self.left[node], allowed_edits(term))
            self.term_at[node] = k
        self.alphabet = {c for node in self.children for c in node}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.known: dict[str, tuple[int, int] | None] = {}
        self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        """The number of a state given as the least edits of each trie node; letters of terms may be left out for an edit each."""
        queue = list(edits)
        for node in queue:
            if edits[node] < self.left[node]:
                for below in self.children[node].values():
                    if edits[node] + 1 <= self.left[below] and edits[node] + 1 < edits.get(below, 99):
                        edits[below] = edits[node] + 1
                        queue.append(below)
        key = frozenset(edits.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = [(e, self.term_at[n]) for n, e in key if self.term_at[n] is not None and e <= allowed_edits(self.terms[self.term_at[n]])]
            self.ends.append(min(ends, default=None))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        """Where a state goes by a letter; -1 if no term is left."""
        edits: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.left[node] and e < edits.get(node, 99):
                edits[node] = e

        for node, e in self.states[state]:
            reach(node, e + 1)  # a letter too many
            for letter, below in self.children[node].items():
                reach(below, e + (letter != c))
        return self._state(edits) if edits else -1

    def find(self, token: str) -> tuple[int, int] | None:
        """``edits, term`` of the nearest term (stems before words, then the first of equals), or none."""
        if token in self.known:
            return self.known[token]
        if len(self.states) > self.most_states or len(self.known) > self.most_tokens:
            self._forget()
        for size in self.stem_sizes:
            if token[:size] in self.stems:
                self.known[token] = 0, self.stems[token[:size]]
                return self.known[token]
        state = 0
        for c in token:
            c = c if c in self.alphabet else _OTHER
            following = self.steps[state].get(c)
            if following is None:
                following = self.steps[state][c] = self._step(state, c)
            if following < 0:
                break
            state = following
        else:
            self.known[token] = self.ends[state]
            return self.ends[state]
        self.known[token] = None
        return None

    def nearest(self, raw: str) -> tuple[int, int] | None:
        """``find`` for a token between spaces: without the marks around it, else for its parts."""
        token = _EDGE.sub("", raw.lower())
        found = self.find(token)
        if found is None and not token.isalnum():
            found = min(filter(None, map(self.find, _PIECE.findall(token))), default=None)
        return found


def _quoted(tokens: list[str], at: int) -> bool:
    """Whether the token stands between marks of quotation or shortly after a word of reporting."""
    before = tokens[max(0, at - WINDOW) : at]
    if any(_EDGE.sub("", t.lower()) in REPORTING for t in before):
        return True
    own = _EDGE.sub("", tokens[at]) or tokens[at]
    opening, _, closing = tokens[at].partition(own)
    head, tail = " ".join([*before, opening]), " ".join([closing, *tokens[at + 1 : at + 1 + WINDOW]])
    for opens, closes in _MARKS.items():
        open_now = head.count(opens) % 2 == 1 if opens == closes else head.rfind(opens) > head.rfind(closes)
        if open_now and closes in tail:
            return True
    return False


def hits(text: str, matcher: Matcher) -> list[tuple[int, int, bool]]:
    """``place, kind, term`` of every hit in a text, in order."""
    tokens = text.split()
    near = {t: x for t in set(tokens) if (x := matcher.nearest(t)) is not None}
    if not near:
        return []
    places = [k for k, t in enumerate(tokens) if t in near]
    out = []
    for i, k in enumerate(places):
        edits, term = near[tokens[k]]
        company = (i and k - places[i - 1] <= WINDOW) or (i + 1 < len(places) and places[i + 1] - k <= WINDOW)
        out.append((k, edits * 4 + 2 * _quoted(tokens, k) + bool(company), term))
    return out


def kinds(text: str | None, matcher: Matcher) -> np.ndarray:
    """How many hits of each kind a text has."""
    return np.bincount([kind for _, kind, _ in hits(text or "", matcher)], minlength=KINDS)


class Model:
    """Weights of the kinds of hit and the logistic function of their sum."""

    def __init__(self, terms: list[str], weights: np.ndarray, slope: float, offset: float) -> None:
        self.terms, self.weights, self.slope, self.offset = terms, weights, slope, offset

    def evidence(self, counts: np.ndarray) -> np.ndarray:
        # More hits of one kind add nothing: a long text may repeat a quotation.
        return (counts > 0) @ self.weights

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(counts) + self.offset, -30, 30)))


def choose_terms(rows: list[tuple[str, int, float]], most: int) -> list[str]:
    """The lexicon from ``term, n, odds``: the most telling first, each only if no relative stands for it already.

    A word's relatives are the stems that it begins with, a stem's those that it
    begins or continues. Of equally telling ones a word goes before a stem and a
    long stem before a short one. Words under a chosen stem follow at the end.
    """
    chosen, forms = [], []
    for term, _, _ in sorted(rows, key=lambda r: (-r[1] * r[2], r[0].endswith("*"), -len(r[0]), r[0])):
        stem = term.removesuffix("*")
        related = [c for c in chosen if (c.endswith("*") and stem.startswith(c[:-1])) or (term.endswith("*") and c.removesuffix("*").startswith(stem))]
        if not related:
            chosen.append(term)
        elif not term.endswith("*"):
            forms.append(term)
    return (chosen + forms)[:most]


def fit_scores(counts: np.ndarray, toxic: np.ndarray, share: float, terms: list[str], prior: float = 4.0) -> Model:
    """Weights of the kinds and the logistic function over their sum, from the sample's counts; ``share`` of all labelled documents are toxic."""
    # Before any data an edit halves and a quotation quarters the odds of a hit; company doubles them.
    believed = np.array([8.0 / 2**edits / (4 if quoted else 1) * (2 if company else 1) for edits in range(3) for quoted in (0, 1) for company in (0, 1)])
    n_toxic, n_clean = max(1, toxic.sum()), max(1, (~toxic).sum())
    with_kind = counts > 0
    in_toxic, in_clean = with_kind[toxic].sum(axis=0) / n_toxic, with_kind[~toxic].sum(axis=0) / n_clean
    strength = prior / (n_toxic + n_clean)
    weights = np.log((in_toxic + strength * believed) / (in_clean + strength))
    model = Model(terms, weights, 1.0, 0.0)
    x = model.evidence(counts)
    scale = max(1e-9, float(np.abs(x).max(initial=0)))
    # Two parameters by Newton's method; both classes weigh as much as among all labelled documents.
    weight = np.where(toxic, share / n_toxic, (1 - share) / n_clean) * len(toxic)
    beta, ridge = np.array([1.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6))]), np.diag([1e-2, 1e-3]) * len(toxic) / 100
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - toxic)) + ridge @ beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return Model(terms, weights, float(max(beta[0], 0.0)) / scale, float(beta[1]))


def _candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``toxic, part, term`` once for each word and stem of each text (columns toxic, text).

    ``part`` is the least hash of the text's five-word shingles: near copies mostly share it.
    """
    for batch in it:
        for toxic, text in zip(*batch.columns):
            words = _PIECE.findall((text.as_py() or "").lower())
            part = min((xxhash.xxh64_intdigest(" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))))
            mine = {w for w in words if 3 <= len(w) <= 40}
            found = sorted(mine | {f"{w[:size]}*" for w in mine for size in STEMS if len(w) > size})
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([toxic.as_py()] * n, pa.bool_()), pa.array([part >> 1] * n, pa.int64()), pa.array(found, pa.string())], names=["toxic", "part", "term"])


def fit(training: DataFrame, labels: DataFrame, *, per_cell: int = 24, most_terms: int = 500, least_docs: int = 3, least_odds: float = 3.0) -> Model:
    """Learns from a bounded sample: ``per_cell`` documents (of ``doc_id, text``) in each of 64 hash cells, for toxic and for clean ones.

    A document is toxic if a label row says so. The lexicon (``most_terms`` at
    most) and the weights come from the sample alone, the share of toxic
    documents from all labels. A term must stand in ``least_docs`` toxic
    documents and have log-odds of ``least_odds``.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.max("toxic") == 1).alias("toxic"))
    ids = training.select(F.col("doc_id").cast("long").alias("label_id")).filter("label_id IS NOT NULL").distinct()
    usable = cut(known.join(ids, "label_id", "left_semi").withColumn("h", F.xxhash64("label_id")))
    order = Window.partitionBy("toxic", F.pmod("h", F.lit(CELLS))).orderBy("h", "label_id")
    # At most 2 * 64 * per_cell ids.
    chosen = usable.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_cell).select("label_id", "toxic")
    sample = training.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(F.broadcast(chosen), "label_id")
    # One text for each id, and equal texts once.
    sample = cut(sample.groupBy("label_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text").distinct())
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(True, 0) / max(1, sum(sizes.values()))
    met = cut(sample.mapInArrow(_candidates, "toxic boolean, part long, term string").distinct())
    parts = met.select("toxic", "part").distinct().groupBy().agg(F.coalesce(F.sum(F.col("toxic").cast("double")), F.lit(0.0)).alias("toxic"), F.coalesce(F.sum((~F.col("toxic")).cast("double")), F.lit(0.0)).alias("clean"))
    n_toxic, n_clean = parts.first()
    words = met.groupBy("term").agg(F.sum(F.col("toxic").cast("double")).alias("t"), F.sum((~F.col("toxic")).cast("double")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    together = F.col("t") + F.col("c")
    of = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = of(F.col("t"), together * (n_toxic / max(1.0, n_toxic + n_clean))) + of(F.col("c"), together * (max(1.0, n_clean) / max(1.0, n_toxic + n_clean)))
    # A chance of one in a hundred that one of all terms tried passes without a reason.
    needed = math.log(100.0 * max(1, words.count()))
    telling = words.filter((F.col("t") >= least_docs) & (odds >= least_odds) & (ratio >= needed)).select("term", F.col("t").alias("n"), odds.alias("odds"))
    terms = choose_terms([tuple(r) for r in telling.orderBy(F.desc(F.col("n") * F.col("odds")), "term").limit(20 * most_terms).collect()], most_terms)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in it:
            found = [kinds(t.as_py(), matcher).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "kinds"])

    if not terms:
        return Model([], np.zeros(KINDS), 0.0, math.log(max(share, 1e-12) / max(1 - share, 1e-12)))
    rows = sample.mapInArrow(counted, "toxic boolean, kinds array<long>").collect()
    counts = np.array([r["kinds"] for r in rows], dtype=np.float64).reshape(-1, KINDS)
    return fit_scores(counts, np.array([r["toxic"] for r in rows], dtype=bool), share, terms)


def score_texts(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, n_hits, terms`` of every row: the score, how many hits and the distinct terms met."""

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for batch in it:
            scores, n_hits, met = [], [], []
            for text in batch.column(1):
                found = hits(text.as_py() or "", matcher)
                counts = np.bincount([kind for _, kind, _ in found], minlength=KINDS)
                scores.append(float(model.score(counts)))
                n_hits.append(len(found))
                met.append(sorted({model.terms[term] for _, _, term in found}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(n_hits, pa.int64()), pa.array(met, pa.list_(pa.string()))], names=["doc_id", "score", "n_hits", "terms"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double, n_hits long, terms array<string>")


def toxicity(documents: DataFrame, training: DataFrame, labels: DataFrame, *, least: float = 0.3, **how) -> DataFrame:
    """``doc_id, score, predicted, n_hits, terms`` of every row of ``documents``, learned from ``training`` and ``labels``.

    ``predicted`` is 1 for scores of ``least`` or more. Null and empty texts
    have no hit and the score of texts without one; where nothing could be
    learned, every score is the share of toxic labels (next to 0 without labels). Texts
    of any length are scored whole; repeated rows stay and are scored alike;
    labels without an id or value are ignored; other columns are ignored; an
    empty table gives an empty result.
    """
    model = fit(training, labels, **how)
    scores = score_texts(documents, model)
    return scores.select("doc_id", "score", (F.col("score") >= least).cast("int").alias("predicted"), "n_hits", "terms")

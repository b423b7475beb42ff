"""Toxicity scores from a learned lexicon, searched with Levenshtein automata.

The lexicon is learned: words, and stems that words begin with, which stand in
many toxic training documents and in few others, each with the logarithm of how
much more often as its weight. It is kept as a trie. A
word of a text that is no entry itself is turned into the Levenshtein automaton
of all strings within EDITS edits of it, which walks the trie along with it;
an entry both accept is a misspelled hit. (With one edit, one half of an entry
is untouched; a word walks only the tries of the entries that share a half with
it, which loses nothing.)

A stem is accepted where the automaton reaches it with some beginning of the word.

Each hit is judged in its context window: a quotation mark that opens before it
and whose partner closes after it make it quoted rather than abusive. The weights of abusive and quoted, exact and misspelled
hits are put together by a logistic regression.

Lexicon and weights are fitted on at most SAMPLE labelled documents a class,
those with the least hash of their id; classes keep their true weights.

Defined results: null and empty texts have no hits and get the score of that;
without training labels of both classes every score is 0; a null label teaches
nothing; repeated rows get equal scores; very long texts are gone through word
by word; of several entries that a word is a misspelling of, the one of the
largest weight counts; an empty table gives no rows. A column of docs that has
the name of the score is replaced by it; others stay.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash

SAMPLE = 10_000
"""Labelled documents a class that lexicon and weights are fitted on."""

MIN_SHARE, MIN_DOCUMENTS = 0.01, 3
"""An entry stands in this share of toxic training documents, and in so many, at least."""

MIN_LIFT = 5.0
"""And stands this many times as often in them as in the others."""

STEM = range(3, 10)
"""Lengths of stems."""

SAME_SHARE = 0.95

EDITS, EDIT_LENGTH = 1, 5
"""Entries of EDIT_LENGTH letters or more are also looked for with so many edits."""

WORD_SHARE = 0.02
"""Whole words that no stem covers stand in this share of toxic training documents at least."""

WINDOW = 8
"""Words on either side of a hit that are its context."""

CLOSING = {'"': '"', "'": "'", "“": "”", "„": "“”", "«": "»", "‘": "’", "»": "«"}
"""The marks that close a quotation, by the one that opens it."""
PUNCTUATION = ".,;:!?()[]{}<>\"'“”„«»‘’…-–—*_/\\|"
CACHE = 200_000


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    entry: str | None = None


def trie(entries: list[str]) -> Node:
    root = Node()
    for entry in entries:
        node = root
        for c in entry:
            node = node.children.setdefault(c, Node())
        node.entry = entry
    return root


class Automaton:
    """Accepts every string within `edits` of word. A state is the row of edit distances to the word's prefixes, cut at edits + 1."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.edits + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        row = [min(state[0] + 1, self.edits + 1)]
        for i, own in enumerate(self.word):
            row.append(min(row[i] + 1, state[i + 1] + 1, state[i] + (own != c), self.edits + 1))
        return tuple(row)

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.edits

    def accepts(self, state: tuple[int, ...]) -> bool:
        return state[-1] <= self.edits


def intersect(automaton: Automaton, root: Node, stems: Container[str] = ()) -> str | None:
    """The least entry that the automaton accepts; of stems, that it accepts with some beginning of its word."""
    found: list[str] = []
    todo = [(root, automaton.start())]
    while todo:
        node, state = todo.pop()
        if node.entry is not None and (automaton.accepts(state) or node.entry in stems and automaton.alive(state)):
            found.append(node.entry)
        for c, child in node.children.items():
            after = automaton.step(state, c)
            if automaton.alive(after):
                todo.append((child, after))
    return min(found, default=None)


class Lexicon:
    """Whole words, and stems (any word that begins so); hits are 'exact' or 'fuzzy'."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], fuzzy: list[str] | None = None):
        self.words, self.stems = words, stems
        self.stem_lengths = sorted({len(s) for s in stems})
        fuzzy = [w for w in ({*words, *stems} if fuzzy is None else fuzzy) if len(w) >= EDIT_LENGTH]
        # The entries that share a head, or a tail and where it begins, are a trie of their own.
        heads: dict[str, list[str]] = {}
        tails: dict[tuple[int, str], list[str]] = {}
        for w in fuzzy:
            heads.setdefault(w[: len(w) // 2], []).append(w)
            tails.setdefault((len(w) // 2, w[len(w) // 2 :]), []).append(w)
        self.heads = {h: trie(own) for h, own in heads.items()}
        self.tails = {t: trie(own) for t, own in tails.items()}
        self.head_sizes, self.tail_sizes = sorted({len(h) for h in heads}), sorted({(at, len(t)) for at, t in tails})
        # What comes later than any entry and one more edit decides nothing but that the word is longer.
        self.longest = max(map(len, fuzzy), default=0) + EDITS + 1
        self.least, self.most = min(map(len, fuzzy), default=1) - EDITS, (math.inf if any(w in stems for w in fuzzy) else max(map(len, fuzzy), default=0) + EDITS)
        self.match = functools.lru_cache(CACHE)(self._match)

    def _match(self, word: str) -> tuple[str, float] | None:
        weights = [self.stems[word[:n]] for n in self.stem_lengths if word[:n] in self.stems]
        if word in self.words:
            weights.append(self.words[word])
        if weights:
            return "exact", max(weights)
        if not self.least <= len(word) <= self.most:
            return None
        roots = [self.heads.get(word[:n]) for n in self.head_sizes]
        roots += [self.tails.get((at, word[at + k : at + k + n])) for at, n in self.tail_sizes for k in range(-EDITS, EDITS + 1)]
        automaton = Automaton(word[: self.longest], EDITS)
        found = [entry for root in roots if root for entry in [intersect(automaton, root, self.stems)] if entry]
        return ("fuzzy", max(max(self.words.get(e, 0.0), self.stems.get(e, 0.0)) for e in found)) if found else None


FEATURES = ("exact", "exact_quoted", "fuzzy", "fuzzy_quoted", "dense")


def quoted(parts: list[str], i: int) -> bool:
    """Whether word i stands between an opening mark of its context window and that mark's partner."""
    closes = lambda p, mark: (bare := p.rstrip(".,;:!?"))[-1:] in tuple(CLOSING[mark]) and len(bare) > 1
    mark = None
    for k in range(max(0, i - WINDOW), i + 1):
        if mark is None and parts[k][0] in CLOSING:
            mark = parts[k][0]
        if mark is not None and k < i and closes(parts[k], mark):
            mark = None
    if mark is None:
        return False
    for k in range(i, min(len(parts), i + WINDOW + 1)):
        if closes(parts[k], mark):
            return True
        if k > i and parts[k][0] == mark:
            return False
    return False


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """ln(1 + weight) of each kind of hit, and the weight of abusive ones by the length."""
    parts = (text or "").lower().split()
    match, sums = lexicon.match, dict.fromkeys(FEATURES[:4], 0.0)
    for i, part in enumerate(parts):
        hit = match(part.strip(PUNCTUATION))
        if hit:
            kind, weight = hit
            sums[f"{kind}_quoted" if quoted(parts, i) else kind] += weight
    abusive = sums["exact"] + sums["fuzzy"]
    return [*np.log1p(list(sums.values())).tolist(), min(1.0, abusive * 10 / max(len(parts), 10))]


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    fuzzy: list[str]
    weights: list[float] | None
    """Bias first; None: nothing was learned."""


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method; the bias is not shrunk."""
    x = np.c_[np.ones(len(x)), x]
    w, shrink = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + shrink @ w
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + shrink, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _chosen(found: dict[str, tuple[int, float]], word_need: float) -> tuple[dict[str, float], dict[str, float], list[str]]:
    """Words and stems with their weights, and those to be looked for misspelled, from entries (stems end in *) with their documents and weight.

    Those that tell most (documents times weight) come first; what begins like
    one taken before, or is the beginning of one, is left out.
    """
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    by_one: dict[str, list[str]] = {}  # the stems that are one letter longer
    for e in sorted(found):
        if e.endswith("*"):
            by_one.setdefault(e[:-2], []).append(e)
    blocked: set[str] = set()
    fuzzy: list[str] = []
    for entry, (documents, weight) in sorted(found.items(), key=lambda x: (-x[1][0] * x[1][1], x[0])):
        name = entry.rstrip("*")
        if any(name[:n] in stems for n in range(1, len(name) + 1)) or entry.endswith("*") and name in blocked or not entry.endswith("*") and documents < word_need:
            continue
        # A beginning that hardly anything else has is better known by more of its letters.
        while entry.endswith("*") and (longer := [e for e in by_one.get(name, []) if found[e][0] >= SAME_SHARE * found[f"{name}*"][0]]):
            name = longer[0][:-1]
            weight = found[longer[0]][1]
        (stems if entry.endswith("*") else words)[name] = weight
        blocked.update(name[:n] for n in range(1, len(name) + 1))
        if len(name) >= EDIT_LENGTH:
            fuzzy.append(name)
    return words, stems, fuzzy


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """labels: doc_id and the label (0 or 1), all for training."""
    drawn = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("label"))
    drawn = drawn.join(docs.select(F.col(doc_id).alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("draw", F.xxhash64("doc_id"))
    drawn = stash(drawn, "labels")
    sizes = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model({}, {}, [], None)
    of = lambda y: drawn.filter(F.col("label") == y).orderBy("draw", "doc_id").limit(sample).select("doc_id", "label")
    chosen = of(0).unionByName(of(1))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = stash(rows, "training")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, labels_of = [], []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = {p.strip(PUNCTUATION) for p in (t.as_py() or "").lower().split()}
                own = {f"{w[:n]}*" for w in words for n in STEM if len(w) >= n} | {w for w in words if len(w) >= STEM[0]}
                found += own
                labels_of += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels_of, pa.int32())], ["entry", "label"])

    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weigh = {y: sizes[y] / totals[y] for y in totals}
    need = max(MIN_DOCUMENTS, MIN_SHARE * totals.get(1, 0))
    toxic, clean = F.sum(F.when(F.col("label") == 1, 1).otherwise(0)), F.sum(F.when(F.col("label") == 0, 1).otherwise(0))
    seen = rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(entries, "entry string, label int").groupBy("entry").agg(toxic.alias("t"), clean.alias("n")).filter(F.col("t") >= need)
    lift = (F.col("t") + 0.5) / (totals.get(1, 0) + 1) / ((F.col("n") + 0.5) / (totals.get(0, 0) + 1))
    seen = seen.withColumn("weight", F.log(lift)).filter(F.col("weight") >= math.log(MIN_LIFT))
    kept = seen.collect()  # each stands in MIN_SHARE of the sampled toxic documents, so there are at most 1 / MIN_SHARE times as many as one of these has
    words, stems, fuzzy = _chosen({r["entry"]: (r["t"], r["weight"]) for r in kept}, WORD_SHARE * totals.get(1, 0))
    shared = docs.sparkSession.sparkContext.broadcast((words, stems, fuzzy))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        for batch in batches:
            xs = [features(t.as_py(), own) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xs, pa.list_(pa.float64()))], ["label", "x"])

    # At most 2 * sample rows of a few numbers come to the driver; equal ones are counted first.
    table = rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(measured, "label int, x array<double>").groupBy("label", "x").count().collect()
    x, y = np.array([r["x"] for r in table]), np.array([r["label"] for r in table], dtype=float)
    weight = np.array([r["count"] * weigh[r["label"]] for r in table])
    weight *= sum(totals.values()) / weight.sum()
    return Model(words, stems, fuzzy, _logistic(x, y, weight).tolist())


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score, from 0 to 1."""
    if model.weights is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.stems, model.fuzzy, model.weights))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        *entries, weights = shared.value
        lexicon, w = Lexicon(*entries), np.array(weights)
        for batch in batches:
            x = np.array([features(t, lexicon) for t in batch]).reshape(-1, len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-(w[0] + x @ w[1:]))))

    return docs.withColumn(name, scored(F.col(text)))

"""Toxicity: a lexicon learned from labels, found through Levenshtein automata on its trie.

Terms that toxic training documents hold more often than chance explains, and others hardly, form a trie. The
product of the trie with the Levenshtein automaton of each of its terms runs over every word of a text, so
misspelled terms are caught in one pass; the product is made deterministic state by state as words
reach it. Each hit is weighed by its context window: quoted or reported words count less, address in the
second person counts more. A logistic model over the hits gives the score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import read, stage

#: Bound of the labelled training rows; those with the smallest hashes of their ids are taken.
TRAIN_ROWS = 20_000
TERMS = 3_000  # at most, by weight
FALSE_TERMS = 0.2  # share of learned terms that may be there by chance
PURITY = 0.95  # share of a term's documents that are toxic
FUZZY_LENGTH = 4  # terms this long may be misspelled by one edit
TRUST = 0.8  # share of documents with misspellings of a term that are toxic, at least
MOVES = 1_000_000  # transitions of the automaton that are kept
WINDOW = 8  # words on either side of a hit
THRESHOLD = 0.7
#: Words of address and of reporting speech, and quotation marks (fixed values).
ADDRESS = frozenset("you your yours you're du dich dir euch ihr tu te toi vous votre usted tú ti".split())
REPORTED = frozenset("said says wrote called quoted quote word term reported insult slur sagte schrieb zitiert dit écrit cité dijo escribió".split())
QUOTES = re.compile("[\"“”«»„‟‘’‚‹›']")
#: What is left of a hit's weight inside quotation marks and near a reporting word.
QUOTED, REPORTING = 0.5, 0.8

WORD = re.compile(r"\w(?:[\w*@$'-]*\w)?")
JAVA_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_*@$'-]*[\p{L}\p{N}_])?"


@dataclass
class _Node:
    children: dict[str, int] = field(default_factory=dict)
    word: float = 0.0  # weight of the term that ends here
    near: float = 0.0  # the same for terms that may be misspelled
    fuzzy: bool = False  # a term long enough for edits passes through


class Automaton:
    """Deterministic product of a lexicon trie and Levenshtein automata of one edit.

    ``terms`` are (text, weight); ``plain`` are words that are no misspelling, ``trust`` is the share of its
    weight that a term's misspellings get (1 unless given). A state is a set of (trie
    node, edits); a state's transitions are computed when a word first takes them.
    """

    def __init__(self, terms: Iterable[tuple[str, float]], plain: Iterable[str] = (), trust: dict[str, float] | None = None):
        self.plain = frozenset(plain)
        self.trie = [_Node()]
        for text, weight in terms:
            path = [0]
            for char in text:
                children = self.trie[path[-1]].children
                if char not in children:
                    children[char] = len(self.trie)
                    self.trie.append(_Node())
                path.append(children[char])
            self.trie[path[-1]].word = max(self.trie[path[-1]].word, weight)
            near = weight * (trust or {}).get(text, 1.0)
            if len(text) >= FUZZY_LENGTH and near:
                for at in path:
                    self.trie[at].fuzzy = True
                self.trie[path[-1]].near = max(self.trie[path[-1]].near, near)
        self._clear()

    def _clear(self) -> None:
        """Forget all states; they are made again as words reach them."""
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[float, float]] = []
        self.taken = 0
        self.dead = self._state(frozenset())
        self.start = self._state(self._closure({(0, 0)}))

    def _closure(self, some: set[tuple[int, int]]) -> frozenset:
        """With the states that a missing letter leads to."""
        return frozenset(some | {(c, 1) for n, e in some if not e for c in self.trie[n].children.values() if self.trie[c].fuzzy})

    def _state(self, inside: frozenset) -> int:
        if inside not in self.ids:
            self.ids[inside] = len(self.states)
            self.states.append(inside)
            self.moves.append({})
            exact = max([0.0, *(self.trie[n].word for n, e in inside if not e)])
            near = 0.0 if exact else max([0.0, *(self.trie[n].near for n, e in inside if e)])
            self.ends.append((exact, near))
        return self.ids[inside]

    def _move(self, state: int, char: str) -> int:
        out: set[tuple[int, int]] = set()
        for n, e in self.states[state]:
            node = self.trie[n]
            if char in node.children and (not e or self.trie[node.children[char]].fuzzy):
                out.add((node.children[char], e))
            if not e and node.fuzzy:
                out.add((n, 1))  # a letter too many
                out |= {(c, 1) for c in node.children.values() if self.trie[c].fuzzy}  # another letter
        self.moves[state][char] = to = self._state(self._closure(out))
        self.taken += 1
        return to

    def find(self, word: str) -> tuple[float, float]:
        """(weight of an exact term, weight of a misspelled term); 0 where there is none."""
        if self.taken > MOVES:
            self._clear()
        at, moves, dead = self.start, self.moves, self.dead
        for char in word:
            to = moves[at].get(char)
            at = self._move(at, char) if to is None else to
            if at == dead:
                return (0.0, 0.0)
        return (self.ends[at][0], 0.0) if word in self.plain else self.ends[at]


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) between an opening mark and the next closing one of its kind, single or double. A mark
    opens before a word and closes behind one; an apostrophe inside a word does neither."""
    out: list[tuple[int, int]] = []
    opened: dict[bool, int] = {}
    for m in QUOTES.finditer(text):
        left, right = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        word, follows = left.isalnum(), right.isalnum()
        if word and follows:
            continue
        single = m[0] in "‘’‚‹›'"
        if bool(left.strip()) == bool(right.strip()):  # marks of one direction between blanks or between signs
            opens = follows or (not word and m[0] in "«“„‘‚‹")
            closes = word or (not follows and m[0] in "»”’›")
        else:
            opens = not left.strip()
            closes = not opens
        if opens:
            opened[single] = m.end()
        elif closes and single in opened:
            out.append((opened.pop(single), m.start()))
    return out


FEATURES = ("hits", "quoted", "share")


def text_features(text: str | None, automaton: Automaton) -> list[float]:
    """Sums of hit weights: what counts, what quotation takes off (on a log scale) and what counts per 100 words."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    found = WORD.findall(low)
    hits = {w: f for w in set(found) if (f := automaton.find(w)) != (0.0, 0.0)}
    if not hits:
        return [0.0] * len(FEATURES)
    total = quoted = 0.0
    matches = list(WORD.finditer(low))
    spans = quoted_spans(low)
    ends = [end for _, end in spans]
    for i, m in enumerate(matches):
        if m[0] not in hits:
            continue
        weight = max(hits[m[0]])
        first, last = max(0, i - WINDOW), min(len(matches) - 1, i + WINDOW)
        window = [x[0] for x in matches[first : last + 1]]
        weight *= 1.25 if any(w in ADDRESS for w in window) else 1.0
        k = bisect_left(ends, m.end())
        marked = k < len(spans) and matches[first].start() <= spans[k][0] <= m.start() and ends[k] <= matches[last].end()
        less = (QUOTED if marked else 1.0) * (REPORTING if any(w in REPORTED for w in window) else 1.0)
        total += less * weight
        quoted += (1 - less) * weight
    return [math.log1p(total), math.log1p(quoted), min(5.0, 100 * total / len(matches))]


@dataclass
class Model:
    terms: list[tuple[str, float]]
    weights: list[float]
    plain: list[str] = field(default_factory=list)
    trust: dict[str, float] = field(default_factory=dict)

    def score(self, row: list[float]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], row, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> list[float]:
    """Penalised logistic regression by Newton's method; the first weight is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def fold(key: Column) -> Column:
    """True for held-out rows: crc32 of the id as text, mod 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _log_tail(t: int, n: int, p: float) -> float:
    """Log of the probability of ``t`` successes or more in ``n`` trials."""
    k = np.arange(t, n + 1)
    terms = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k]) + k * math.log(p) + (n - k) * math.log1p(-p)
    return float(terms.max() + np.log(np.exp(terms - terms.max()).sum()))


def _by_chance(sorted_logs: list[float], tested: int) -> int:
    """Benjamini and Hochberg: how many of the smallest probabilities (as logs) pass among ``tested``."""
    return max((i + 1 for i, x in enumerate(sorted_logs) if x <= math.log(FALSE_TERMS * (i + 1) / tested)), default=0)


def _learn_terms(train: DataFrame) -> list[tuple[str, float]]:
    """Terms that toxic documents hold more often than chance explains; ``train`` has text and toxic.

    What support a term needs follows from the share of toxic documents and the number of terms tested, so
    rare terms of small languages count. Copies of one text are no support: a term counts as often as it
    has different neighbours at most.
    """
    total = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return []
    share = bad / (bad + good)
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(JAVA_WORD), F.lit(0))
    held = train.select("toxic", words.alias("w"))
    counts = held.select("toxic", F.explode(F.array_distinct("w")).alias("term")).groupBy("term")
    counts = stage(counts.agg(F.sum("toxic").cast("int").alias("t"), F.count("*").cast("int").alias("n")).where("n > 1"), "counts")
    tested = counts.count()
    pure = counts.where(F.col("t") >= PURITY * F.col("n"))
    cells = {(r["t"], r["n"]): r["count"] for r in pure.groupBy("t", "n").count().collect()}
    logs = {cell: _log_tail(*cell, share) for cell in cells}
    ordered = sorted(x for cell, x in logs.items() for _ in range(cells[cell]))
    passed = _by_chance(ordered, tested)
    if not passed:
        return []
    # Neighbours can only lessen a term's support, so no other term can pass later.
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (good + 1))
    fit = train.sparkSession.createDataFrame([cell for cell, x in logs.items() if x <= ordered[passed - 1]], "t int, n int")
    rows = pure.join(F.broadcast(fit), ["t", "n"]).select("term", "t", "n", odds.alias("weight"))
    rows = {r["term"]: r for r in rows.orderBy(F.desc("weight"), "term").limit(TERMS).collect()}
    near = F.transform("w", lambda w, i: F.struct(w.alias("term"), F.get("w", i - 1).alias("a"), F.get("w", i + 1).alias("b")))
    near = held.where("toxic = 1").select(F.explode(near).alias("p")).where(F.col("p.term").isin(*rows)).select("p.*").distinct()
    varied = {r["term"]: r["count"] for r in near.groupBy("term").count().collect()}
    found = []
    for term, r in rows.items():
        t = min(r["t"], varied[term])
        found.append((_log_tail(t, t + r["n"] - r["t"], share), term))
    found.sort()
    found = found[: _by_chance([x for x, _ in found], tested)]
    return sorted((term, float(rows[term]["weight"])) for _, term in found)


def _near_words(train: DataFrame, terms: list[tuple[str, float]]) -> tuple[dict[str, set[int]], dict[str, float]]:
    """Words of clean documents that are one edit from a term (such as an 'oron'), with the parts they occur
    in, and the trust in each term's misspellings: the share of toxic ones among the documents that
    hold such a form, plain words of the other part aside, with one toxic document presumed and none
    below ``TRUST``. ``train`` has text, toxic and part."""
    ranked = sorted(terms, key=lambda x: (x[1], x[0]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton([(text, k + 1.0) for k, (text, _) in enumerate(ranked)])
        for batch in batches:
            batch["rank"] = [int(automaton.find(w)[1]) for w in batch["word"]]
            yield batch[batch["rank"] > 0]

    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(JAVA_WORD), F.lit(0))
    held = train.select("toxic", "part", F.explode(F.array_distinct(words)).alias("word"))
    held = held.where(F.length("word").between(FUZZY_LENGTH - 1, max(len(t) for t, _ in terms) + 1))
    near = held.mapInPandas(run, "toxic int, part int, word string, rank int").groupBy("rank", "word", "toxic", "part").count()
    rows = near.collect()  # words near at most TERMS terms
    plain: dict[str, set[int]] = {}
    for r in rows:
        if not r["toxic"]:
            plain.setdefault(r["word"], set()).add(r["part"])
    tally = {text: [0, 1] for text, _ in terms}
    for r in rows:
        if 1 - r["part"] not in plain.get(r["word"], ()):
            tally[ranked[r["rank"] - 1][0]][r["toxic"]] += r["count"]
    trust = {text: bad / (bad + good) for text, (good, bad) in tally.items()}
    return plain, {text: x if x >= TRUST else 0.0 for text, x in trust.items()}


def _features(rows: DataFrame, terms: list[tuple[str, float]], kept: str, plain: Iterable[str], trust: dict[str, float]) -> DataFrame:
    """``rows`` (first column text) as its other columns, given as DDL in ``kept``, and features."""
    plain = list(plain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(terms, plain, trust)
        for batch in batches:
            out = batch.iloc[:, 1:].copy()
            rows = np.array([text_features(t, automaton) for t in batch.iloc[:, 0]]).reshape(len(batch), len(FEATURES))
            for k, name in enumerate(FEATURES):
                out[name] = rows[:, k]
            yield out

    return rows.mapInPandas(run, f"{kept}, " + ", ".join(f"{f} double" for f in FEATURES))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", bound: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold, ``bound`` of them at most.

    Null ids, labels other than 0 and 1 and labels without a document are passed over; a
    document with several labels counts as toxic if one says so, and of several texts with one id the
    smallest is taken. The bounded rows are staged once; nothing else reads the documents.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & ~fold(F.col(key)))
    known = known.groupBy(key).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(key), key).limit(bound)
    known = F.broadcast(known.select(F.col(key).alias("_key"), "toxic"))  # bounded rows of two numbers
    part = F.pmod(F.xxhash64("_key"), F.lit(2)).cast("int").alias("part")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(known, "_key")
    rows = rows.groupBy("_key").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    rows = stage(rows.select("text", "toxic", part), "train")
    terms = _learn_terms(rows)
    if not terms:
        return Model([], [-3.0, 1.0, 0.0, 0.0])
    plain, trust = _near_words(rows, terms)
    # Weights are learned from exact hits; misspelled ones are rare in labels, and trust scales them.
    exact = _features(rows.select("text", "toxic"), terms, "toxic int", (), dict.fromkeys(trust, 0.0))
    table = exact.toPandas()  # at most ``bound`` labelled documents
    return Model(terms, logistic(table[list(FEATURES)].to_numpy(), table["toxic"].to_numpy()), sorted(plain), trust)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, held_out, score, predicted.

    Null and empty texts get the score of a text without hits; repeated rows and null keys are
    kept; an empty table gives an empty result; other columns are never looked at.
    """
    frame = docs.select(F.col(text).alias("_text"), F.col(key).alias("_key"))
    scored = _features(frame, model.terms, f"_key {dict(frame.dtypes)['_key']}", model.plain, model.trust)
    z = F.lit(model.weights[0])
    for w, name in zip(model.weights[1:], FEATURES, strict=True):
        z = z + w * F.col(name)
    value = 1 / (1 + F.exp(-z))
    return scored.select(
        F.col("_key").alias(key),
        fold(F.col("_key")).alias("held_out"),
        value.alias("score"),
        F.when(value >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))

"""Toxicity by a weighted finite-state pattern grammar.

Insult patterns (whole words and word beginnings) and their weights are learned from labelled rows; threats, targets, negation
and reported speech are short word lists in four languages. Five transducers read the classes of a clause's words and mark
insults and threats; their composition is one machine, whose states hold what of the clause is in force: a negation and how
far it still reaches, a report, a target. By these marks each match goes to a channel (plain, targeted, reported or negated,
for insults and threats). A document's score is a logistic function of its channels' summed weights, of how many patterns
matched, how many different ones and how densely. What a channel counts for is calibrated on the labelled rows, starting from
PRIOR; a channel that they never show keeps its prior.

A pattern scan finds the clauses that hold an insult or threat at all; only those are read word by word, each once.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

THRESHOLD = 0.7
#: Labelled rows that the model is fitted on: those with the least hashes, at most so many. A row is used whole.
FIT_ROWS = 20_000
PREFIXES = (4, 5, 6, 7, 8)
#: A pattern must occur between so many different pairs of neighbouring words in labelled toxic rows (copies of one text
#: do not count again), and be so much more frequent (log odds) in toxic rows.
MIN_SUPPORT, MIN_ODDS = 6, 2.5
#: A pattern that a shorter one covers is kept only with so much higher log odds.
MIN_GAIN = 0.7
#: Weights before calibration: the intercept, each channel's log clause weight, log matches, different patterns, log density.
CHANNELS = tuple(f"{kind} {how}" for kind in ("insult", "threat") for how in ("plain", "targeted", "reported", "negated"))
PRIOR = (-4.0, 0.5, 0.75, 0.25, 0.1, 0.0, 1.0, 0.25, 0.0, 1.0, 0.5, 0.5)
FEATURES = len(PRIOR)
RIDGE = 0.05

#: Word lists of the grammar: small closed classes of English, German, French and Spanish.
THREAT = "kill murder hurt destroy beat stab shoot töte töten umbringen schlagen tuer tuerai frapper détruire matar mataré golpear destruir".split()
TARGET = "you your yours they them du dich dir ihr euch sie tu te toi vous ils tú ti te usted ustedes ellos".split()
NEGATION = "not no never nobody isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split()
REPORTED = "said says reported quoted called wrote claims sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
LETTERS = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n|]")


CLASSES = ("insult", "threat", "target", "negation", "reported", "other")
#: Words that a negation reaches.
REACH = 3


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, word class) to (next state, marks); state 0 is the first, other words keep the state and mark nothing."""

    arcs: dict[tuple[int, str], tuple[int, str]]

    def step(self, state: int, kind: str) -> tuple[int, str]:
        return self.arcs.get((state, kind), (state, ""))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that reads like both at once and writes both marks; its states are the pairs that can be reached."""
    number, queue, arcs = {(0, 0): 0}, [(0, 0)], {}
    for pair in queue:  # grows while it is read
        for kind in CLASSES:
            (x, m), (y, n) = a.step(pair[0], kind), b.step(pair[1], kind)
            if (x, y) not in number:
                number[x, y] = len(number)
                queue.append((x, y))
            arcs[number[pair], kind] = (number[x, y], m + n)
    return Transducer(arcs)


_HITS = ("insult", "threat")
INSULTING = Transducer({(0, "insult"): (0, "i")})
THREATENING = Transducer({(0, "threat"): (0, "k")})
TARGETING = Transducer({(0, "target"): (1, "")} | {(1, k): (1, "t") for k in _HITS})
REPORTING = Transducer({(0, "reported"): (1, "")} | {(1, k): (1, "r") for k in _HITS})
#: States count the words that the negation still reaches.
NEGATING = Transducer({(s, k): (s - 1, "n" if k in _HITS else "") for s in range(1, REACH + 1) for k in CLASSES} | {(s, "negation"): (REACH, "") for s in range(REACH + 1)})
GRAMMAR = reduce(compose, (INSULTING, THREATENING, TARGETING, REPORTING, NEGATING))


def channel(marks: str) -> int:
    """The channel of a marked word: a negation outweighs a report, and a report a target."""
    how = "negated" if "n" in marks else "reported" if "r" in marks else "targeted" if "t" in marks else "plain"
    return CHANNELS.index(f"{'insult' if 'i' in marks else 'threat'} {how}")


def clause_weights(words: list[tuple[str, float]]) -> np.ndarray:
    """(matches, summed weight) of each channel for a clause, given the class and weight of its words."""
    state, out = 0, np.zeros((len(CHANNELS), 2))
    for kind, weight in words:
        state, marks = GRAMMAR.step(state, kind)
        if marks:
            out[channel(marks)] += (1.0, weight)
    return out


def patterns(text: str) -> dict[str, set[tuple[str, str]]]:
    """The patterns of a text: "=word" and "beginning*", each with the pairs of words around its matches."""
    words = LETTERS.findall(text.lower())
    out: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for i, w in enumerate(words):
        around = (words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
        out["=" + w].add(around)
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "*"].add(around)
    return out


@dataclass
class Model:
    """lexicon: pattern to weight; coef: of the features, see PRIOR."""

    lexicon: dict[str, float] = field(default_factory=dict)
    coef: tuple[float, ...] = PRIOR

    def __post_init__(self):
        self.machine = ahocorasick.Automaton()
        forms: dict[str, set[str]] = defaultdict(set)  # "=word" and "word*" have the same string
        for p in [*self.lexicon, *("=" + w for w in THREAT)]:
            forms[p.strip("=*")].add(p)
        for string, found in forms.items():
            self.machine.add_word(string, (string, sorted(found)))
        self.machine.make_automaton()
        self.lists = {w: kind for kind, ws in (("reported", REPORTED), ("target", TARGET), ("threat", THREAT), ("negation", NEGATION)) for w in ws}

    def word_class(self, word: str) -> tuple[str, float]:
        weight = max((self.lexicon.get(p, 0.0) for p in ("=" + word, *(word[:k] + "*" for k in PREFIXES if len(word) > k))))
        if weight:
            return "insult", weight
        kind = self.lists.get(word, "other")
        return kind, 1.0 if kind == "threat" else 0.0

    def features(self, text: str | None) -> np.ndarray:
        low, ends, clauses, starts = (text or "").lower(), None, set(), set()
        for end, (string, found) in self.machine.iter(low):
            start = end - len(string) + 1
            whole = not (end + 1 < len(low) and low[end + 1].isalpha())
            matched = [p for p in found if (p[0] == "=") == whole]
            if (start and low[start - 1].isalpha()) or not matched:
                continue
            if any(p in self.lexicon for p in matched):
                starts.add(low[start : start + PREFIXES[0]])
            if ends is None:  # once for a text, however many of its clauses match
                ends = [-1, *(m.start() for m in CLAUSE_END.finditer(low)), len(low)]
            clauses.add(bisect_left(ends, start))
        out = np.zeros(FEATURES)
        out[0] = 1.0
        if clauses:
            found = sum(clause_weights([self.word_class(w) for w in WORD.findall(low, ends[c - 1] + 1, ends[c])]) for c in sorted(clauses))
            n = found[:4, 0].sum()
            out[1:9] = np.log1p(found[:, 1])
            out[9:] = math.log1p(n), min(len(starts), 4), math.log1p(1000 * n / max(20, len(low.split())))
        return out

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-float(np.clip(self.features(text) @ np.array(self.coef), -30, 30))))


def trains(doc_id) -> bool:
    """Whether a row may be learned from: crc32 of its id's text leaves another remainder than 1 by 3."""
    return zlib.crc32(str(doc_id).encode()) % 3 != 1


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of the rows to learn from, at most ``rows``: those with the least hash of doc_id."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic")
    own = own.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # at most ``rows`` pairs of numbers: texts are read where they lie
    return text.join(F.broadcast(own), F.col("doc_id") == F.col("id")).select("text", "toxic")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Patterns that mark toxic rows, with log odds as weights, without those that a shorter one covers."""
    n_toxic, n = rows.agg(F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)), F.count("*")).first()
    if not n_toxic:
        return {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Occurrences in clean rows by pattern, and the pairs of neighbours in toxic ones."""
        for pdf in batches:
            clean, pairs = Counter(), defaultdict(set)
            for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
                for p, around in patterns(text).items():
                    if y:
                        pairs[p] |= {zlib.crc32(" ".join(a).encode()) for a in around}
                    else:
                        clean[p] += len(around)
            keys = list(clean.keys() | pairs.keys())
            yield pd.DataFrame({"p": keys, "clean": [clean[k] for k in keys], "pairs": [list(pairs.get(k, ())) for k in keys]})

    counts = materialize(rows.mapInPandas(count, "p string, clean long, pairs array<long>"), "patterns")
    contexts = counts.select("p", F.explode("pairs").alias("c")).distinct().groupBy("p").agg(F.count("*").alias("toxic"))
    contexts = contexts.where(f"toxic >= {MIN_SUPPORT}")
    found = counts.groupBy("p").agg(F.sum("clean").alias("clean")).join(contexts, "p")
    rate = (F.col("toxic") + 0.5) / (n_toxic + 1)
    found = found.withColumn("odds", F.log(rate / ((F.col("clean") + 0.5) / (n - n_toxic + 1)))).where(f"odds >= {MIN_ODDS}")
    # the fit is bounded by FIT_ROWS, and so is what it finds
    got = {r.p: r.odds for r in found.select("p", "odds").collect()}
    kept: dict[str, float] = {}
    for p in sorted(got, key=lambda p: (len(p), p)):
        word = p.strip("=*")
        shorter = [kept[q] for k in PREFIXES if len(word) > k - (p[0] == "=") and (q := word[:k] + "*") in kept and q != p]
        if got[p] >= max(shorter, default=-MIN_GAIN) + MIN_GAIN:
            kept[p] = got[p]
    return kept


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model of at most ``rows`` labelled rows; without toxic labels, one that knows only the word lists."""
    train = materialize(labelled(docs, labels, rows).repartition(24), "labelled")
    model = Model(learn_lexicon(train))
    if not model.lexicon:
        return model

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(model.lexicon)
        for pdf in batches:
            x = np.array([own.features(t) for t in pdf["text"]]).reshape(-1, FEATURES)
            yield pd.DataFrame(x[:, 1:], columns=names[:-1]).assign(y=pdf["toxic"].to_numpy(float))

    names = [*(f"x{i}" for i in range(1, FEATURES)), "y"]
    grouped = train.mapInPandas(extract, ", ".join(f"{c} double" for c in names)).groupBy(names).count()
    data = np.array([list(r) for r in grouped.collect()], float)  # at most ``rows`` rows of a few numbers
    data = data[np.lexsort(data.T)]
    x, y, w = np.column_stack([np.ones(len(data)), data[:, : FEATURES - 1]]), data[:, FEATURES - 1], data[:, FEATURES]
    prior, use = np.array(PRIOR), np.ones(FEATURES, bool)
    coef = prior.copy()
    while True:  # Newton steps for logistic regression drawn to the prior; evidence never counts against toxicity
        coef[use] = prior[use]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
            grad = x.T @ (w * (p - y)) + RIDGE * (coef - prior)
            hess = (x.T * (w * p * (1 - p))) @ x + RIDGE * np.eye(FEATURES)
            step = np.linalg.solve(hess[np.ix_(use, use)], grad[use])
            coef[use] -= step
            if np.abs(step).max() < 1e-9:
                break
        worst = 1 + int(np.argmin(coef[1:]))
        if coef[worst] >= 0:
            break
        use[worst], coef[worst] = False, 0.0
    return Model(model.lexicon, tuple(float(c) for c in coef))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column toxicity (0 to 1). Null texts count as empty; an existing column of that name is replaced."""
    lexicon, coef = model.lexicon, model.coef
    own: list[Model] = []

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not own:
            own.append(Model(lexicon, coef))
        return pd.Series([own[0].score(t) for t in texts], dtype=float)

    return docs.withColumn("toxicity", run("text"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least the threshold; all columns kept."""
    model = fit(docs, labels)
    scored = score_documents(docs.select(F.struct("*").alias("row"), F.col("text")), model)
    return scored.where(F.col("toxicity") < threshold).select("row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted")
    )

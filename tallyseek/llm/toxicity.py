"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read a clause word by word: insults and threats (weighted, from a lexicon), targets (who is
addressed), negation (holds for the next few words) and reported speech (holds to the end of the clause).  Their product is one
automaton; it emits a weight under a pattern name for each insult or threat, by the state of the other four.  A
text's score is a logistic function of what its clauses emitted, so single words never score alone: their clause does.
The insult lexicon (whole words and word beginnings) and the pattern weights are learned from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseek.llm.common import bounded_sample, stored

# Bounds of the fitted model.
TRAIN_DOCS = 12_000
KEEP_CANDIDATES = 20_000
BEGINNINGS = (4, 5, 6, 7, 8)
LEAST_SUPPORT = 4
LEAST_PRECISION = 0.9
# A second explanation must serve this share of the toxic documents, more than a family of copies holds.
SECOND_SHARE = 0.03

# Fixed closed-class words of the grammar (English, German, French, Spanish).
TARGETS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu toi ton ta vous votre tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never neither nor don't isn't aren't nicht kein keine nie niemals ne pas jamais nunca jamás tampoco".split())
REPORTS = frozenset("said says say called calls wrote writes claimed told reported sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())
THREATS = frozenset("kill murder hurt destroy shoot stab strangle töten umbringen verletzen tuer frapper détruire matar golpear destruir".split())
NEGATION_REACH = 3

_TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]|[\"“”„«»]")
_CLAUSE_ENDS = frozenset(".!?;:\n")
_QUOTES = frozenset("\"“”„«»")

# What an insult or threat can be emitted as, by the state of the other transducers.
PATTERNS = [
    f"{kind}{how}"
    for kind in ("insult", "threat")
    for how in ("", "+target", "+negated", "+reported", "+negated+target", "+reported+target", "+negated+reported", "+negated+reported+target")
]


class Transducer:
    """States and arcs (state, symbol) -> state; symbols without an arc keep the state, `*` is any other symbol."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), self.arcs.get((state, "*"), state))


def grammar() -> tuple[int, dict[tuple[int, str], int], list[tuple]]:
    """The product of the context transducers: start, arcs, and what each state means (negated, reported, target)."""
    negation = Transducer(
        0,
        {(n, "NEG"): NEGATION_REACH for n in range(NEGATION_REACH + 1)}
        | {(n, "*"): n - 1 for n in range(1, NEGATION_REACH + 1)},
    )
    # 1: after a verb of speech; 2: inside quotation marks.
    report = Transducer(0, {(0, "REP"): 1, (0, "QUOTE"): 2, (1, "QUOTE"): 2, (2, "QUOTE"): 0})
    target = Transducer(0, {(0, "TGT"): 1})
    parts = (negation, report, target)
    states = {tuple(p.start for p in parts): 0}
    arcs: dict[tuple[int, str], int] = {}
    todo = list(states)
    while todo:
        state = todo.pop()
        for symbol in ("NEG", "REP", "QUOTE", "TGT", "INS", "THR", "WORD"):
            after = tuple(p.step(s, symbol) for p, s in zip(parts, state))
            if after not in states:
                states[after] = len(states)
                todo.append(after)
            arcs[states[state], symbol] = states[after]
    return 0, arcs, [(s[0] > 0, s[1] > 0, s[2] > 0) for s in states]


class ClauseGrammar:
    """Lexicon, product automaton and learned pattern weights."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings
        self.lengths = sorted({len(b) for b in beginnings}, reverse=True)
        self.start, self.arcs, self.meaning = grammar()
        self.weights = np.zeros(len(PATTERNS) + 1)

    def insult(self, word: str) -> float:
        """Weight of a word in the insult transducer's lexicon; 0 if it has none."""
        found = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) >= n:
                found = max(found, self.beginnings.get(word[:n], 0.0))
        return found

    def emissions(self, text: str | None) -> np.ndarray:
        """Sum of emitted weights by pattern over all clauses of the whole text."""
        out = np.zeros(len(PATTERNS))
        lowered = (text or "").lower()
        tokens = _TOKENS.findall(lowered)
        weight = {w: x for w in set(tokens) if (x := self.insult(w)) or w in THREATS}
        if not weight:
            return out
        clause: list[str] = []
        for token in [*tokens, "."]:
            if token not in _CLAUSE_ENDS:
                clause.append(token)
                continue
            if any(t in weight for t in clause):
                self._clause(clause, weight, out)
            clause = []
        return out

    def _clause(self, clause: list[str], weight: dict[str, float], out: np.ndarray) -> None:
        state, arcs = self.start, self.arcs
        found = []
        for token in clause:
            if token in weight:
                symbol = "THR" if token in THREATS else "INS"
                negated, reported, _ = self.meaning[state]
                found.append((symbol, negated, reported, weight[token] or 1.0))
            elif token in NEGATIONS:
                symbol = "NEG"
            elif token in REPORTS:
                symbol = "REP"
            elif token in _QUOTES:
                symbol = "QUOTE"
            elif token in TARGETS:
                symbol = "TGT"
            else:
                symbol = "WORD"
            state = arcs[state, symbol]
        # The target may stand before or after the insult, so it is read off the clause's last state.
        aimed = self.meaning[state][2]
        for symbol, negated, reported, x in found:
            at = (8 if symbol == "THR" else 0) + _CONTEXTS[negated, reported, aimed]
            out[at] += x

    def score(self, emitted: np.ndarray) -> float:
        z = self.weights[-1] + float(np.log1p(emitted) @ self.weights[:-1])
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))

    def fit(self, emitted: np.ndarray, labels: np.ndarray) -> None:
        """Non-negative pattern weights and a bias by logistic regression (projected Newton-like steps)."""
        x = np.hstack([np.log1p(emitted), np.ones((len(emitted), 1))])
        w = np.zeros(x.shape[1])
        w[: len(PATTERNS)] = 1.0
        w[-1] = -2.0
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (p - labels) + 0.05 * np.r_[w[:-1] - 1.0, 0.0]
            bend = (x * x).T @ (p * (1 - p)) + 0.05
            w -= 0.5 * slope / np.maximum(bend * 2, 0.5)
            w[:-1] = np.maximum(w[:-1], 0.0)
        self.weights = w


_CONTEXTS = {
    (False, False, False): 0, (False, False, True): 1, (True, False, False): 2, (False, True, False): 3,
    (True, False, True): 4, (False, True, True): 5, (True, True, False): 6, (True, True, True): 7,
}


def _features(text: str | None) -> set[str]:
    """Words and word beginnings (marked by `*`)."""
    words = {t for t in _TOKENS.findall((text or "").lower()) if t[0].isalpha()}
    return words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) > n}


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counted = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counted[1 if toxic else 0].update(_features(text))
    for toxic, found in enumerate(counted):
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found)), pa.array([toxic] * len(found), type=pa.int32()), pa.array(list(found.values()), type=pa.int64())],
                names=["feature", "toxic", "n"],
            )


def _cover(toxic_docs: list[list[str]], counts: dict[str, tuple[int, int]]) -> list[str]:
    """Greedy cover, twice: the feature that explains most toxic documents not yet explained, again and again.

    The second pass looks for another explanation of each document, so that an insult is learned even where others
    stand beside it.  Copies of one text share all their words; once an insult explains them, their other words gain nothing.  Of
    equals, the one with fewer clean documents, then the longer, then the first by code point.
    """
    holders: dict[str, set[int]] = {}
    for i, found in enumerate(toxic_docs):
        for f in found:
            holders.setdefault(f, set()).add(i)
    chosen: list[str] = []
    for least in (LEAST_SUPPORT, max(LEAST_SUPPORT, SECOND_SHARE * len(toxic_docs))):
        left = set(range(len(toxic_docs)))
        holders = {f: h for f, h in holders.items() if len(h) >= least and not _told_by(f, chosen)}
        while left:
            best = max(
                ((len(h & left), -counts[f][0], len(f), f) for f, h in holders.items()),
                default=(0, 0, 0, ""),
            )
            if best[0] < least:
                break
            chosen.append(best[3])
            left -= holders.pop(best[3])
    return chosen


def _told_by(feature: str, chosen: list[str]) -> bool:
    """Whether a chosen beginning already covers the feature, or the feature is the beginning of a chosen one."""
    plain = feature.rstrip("*")
    return any(
        (c.endswith("*") and plain.startswith(c[:-1])) or (feature.endswith("*") and c.rstrip("*").startswith(plain))
        for c in chosen
    )


def fit_grammar(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", key: str = "doc_id") -> ClauseGrammar:
    """Learn lexicon and pattern weights from at most about TRAIN_DOCS labelled rows; null labels teach nothing."""
    drawn = bounded_sample(labelled.filter(F.col(label_col).isNotNull()), key, TRAIN_DOCS)
    sample = stored(drawn.select(F.col(text_col).alias("text"), (F.col(label_col) > 0).alias("toxic")))
    counts = (
        sample.mapInArrow(_count_features, "feature string, toxic int, n long")
        .groupBy("feature")
        .agg(F.sum(F.col("n") * (1 - F.col("toxic"))).alias("clean"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
        .filter((F.col("toxic") >= LEAST_SUPPORT) & (F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean"))))
        .orderBy(F.desc("toxic"), "feature")
        .limit(KEEP_CANDIDATES)
        .collect()
    )
    by_feature = {r["feature"]: (r["clean"], r["toxic"]) for r in counts}
    shared = sample.sparkSession.sparkContext.broadcast(frozenset(by_feature))

    def toxic_features(batches):
        for batch in batches:
            found = [sorted(_features(x.as_py()) & shared.value) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.list_(pa.string()))], names=["found"])

    toxic_docs = [
        r["found"] for r in sample.filter("toxic").select("text").mapInArrow(toxic_features, "found array<string>").collect()
    ]
    chosen = _cover(toxic_docs, by_feature)
    weigh = {f: math.log((by_feature[f][1] + 0.5) / (by_feature[f][0] + 0.5)) for f in chosen}
    model = ClauseGrammar(
        {f: w for f, w in weigh.items() if not f.endswith("*")},
        {f[:-1]: w for f, w in weigh.items() if f.endswith("*")},
    )
    emitted = (
        _emit(sample, model, ["toxic"]).groupBy("emitted", "toxic").count().collect()
    )  # as few rows as there are different emissions of the bounded sample
    if emitted:
        x = np.array([r["emitted"] for r in emitted for _ in range(r["count"])])
        y = np.array([float(r["toxic"]) for r in emitted for _ in range(r["count"])])
        model.fit(x, y)
    return model


def _emit(docs: DataFrame, model: ClauseGrammar, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.emissions(x.as_py()).tolist() for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, type=pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "emitted"]
            )

    given = docs.select(*keep, "text")
    return given.mapInArrow(run, given.drop("text").schema.add("emitted", T.ArrayType(T.DoubleType())))


def score_toxicity(docs: DataFrame, model: ClauseGrammar, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row with score (0 to 1) and predicted (1 if score >= 0.5).

    Null and empty texts emit nothing and get the score of a text without matches.  Repeated rows are scored alike;
    only `keep` and the text are read, so other columns never matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            grammar_ = shared.value
            found = [grammar_.score(grammar_.emissions(x.as_py())) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(found, type=pa.float64()),
                    pa.array([int(s >= 0.5) for s in found], type=pa.int32()),
                ],
                names=[*batch.schema.names[:-1], "score", "predicted"],
            )

    given = docs.select(*keep, F.col(text_col).alias("_text"))
    return given.mapInArrow(run, given.drop("_text").schema.add("score", "double").add("predicted", "integer"))

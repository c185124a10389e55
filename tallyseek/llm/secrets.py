"""Secret scanning: loose candidates, then a random forest that removes false positives.

The forest sees a candidate's length, its character transitions, how much of it dictionary words cover, whether it
stands in a path or address, and the words next to it.  It learns from labelled findings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseek.llm.common import bounded_sample, stored

# Bounds of the fitted model: labelled findings it learns from (half of them of either label), and dictionary words.
TRAIN_FINDINGS = 20_000
DICTIONARY_WORDS = 20_000
TREES, DEPTH = 20, 8
CONTEXT = 48

# A candidate: a run of key characters with a digit and a letter in it, at least 12 long.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/=.@-])(?=[A-Za-z_+/=.@-]*[0-9])(?=[0-9_+/=.@-]*[A-Za-z])[A-Za-z0-9_+/=.@-]{12,}")

# Fixed words whose neighbourhood speaks for or against a secret.
NAMES = frozenset("password passwd pwd secret token key apikey api_key access_key auth bearer credential private".split())
HARMLESS = frozenset("sha1 sha256 md5 commit uuid guid checksum hash version order invoice isbn id mail email".split())

FEATURES = [
    "length", "digits", "uppers", "lowers", "hexes", "others", "turns", "entropy", "transition", "covered",
    "path", "address", "assigned", "quoted", "named", "name_inside", "harmless", "before_known", "after_known",
]

_WORDS = re.compile(r"[^\W\d_]+")
_VALUE = re.compile(r"^(?:([A-Za-z_][A-Za-z0-9_.-]*)=)?(.*)$", re.S)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


class SecretContext:
    """Dictionary and character transitions of counted words."""

    def __init__(self, words: dict[str, int]):
        self.words = {w for w in words if len(w) >= 3}
        self.longest = max(map(len, self.words), default=0)
        pairs: Counter = Counter()
        for w, n in words.items():
            for pair in zip(f"<{w}", f"{w}>"):
                pairs[pair] += n
        firsts: Counter = Counter()
        for (a, _), n in pairs.items():
            firsts[a] += n
        self.chance = {p: math.log((n + 0.1) / (firsts[p[0]] + 10.0)) for p, n in pairs.items()}

    def covered(self, value: str) -> float:
        """Share of the characters inside dictionary words, longest first from the left."""
        low, i, hit = value.lower(), 0, 0
        while i < len(low):
            for n in range(min(self.longest, len(low) - i, 16), 2, -1):
                if low[i : i + n] in self.words:
                    hit, i = hit + n, i + n
                    break
            else:
                i += 1
        return hit / max(len(low), 1)

    def features(self, text: str, start: int, end: int) -> list[float]:
        """Numbers for one candidate; reads only CONTEXT characters to either side."""
        name, value = _VALUE.match(text[start:end]).groups()
        value = value.strip(".-=/") or value or "-"
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        n = len(value)
        kinds = [_kind(c) for c in value]
        counted = Counter(value)
        last = _WORDS.findall(before.lower())[-2:]
        following = _WORDS.findall(after.lower())[:2]
        low = value.lower()
        glue = before.rstrip()
        return [
            float(n), kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n,
            sum(c in "0123456789abcdef" for c in low) / n, kinds.count(3) / n,
            sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
            -sum(c / n * math.log2(c / n) for c in counted.values()),
            sum(self.chance.get(p, -8.0) for p in zip(low, low[1:])) / n,
            self.covered(value),
            float(value.count("/")), float("@" in value or "." in value),
            float(name is not None or glue.endswith(("=", ":")) or bool(re.search(r"[=:]\s*[\"']?$", before))),
            float(before.endswith(('"', "'")) and after.startswith(('"', "'"))),
            float(any(w in NAMES for w in last) or (name or "").lower() in NAMES),
            float(any(w in low for w in NAMES)), float(any(w in HARMLESS for w in last)),
            float(bool(last) and last[-1] in self.words), float(bool(following) and following[0] in self.words),
        ]


def fit_context(docs: DataFrame, text_col: str = "text") -> SecretContext:
    """Dictionary of the DICTIONARY_WORDS most frequent words; every document is counted.

    Words are counted inside each task before the shuffle.
    """
    rows = (
        docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")).alias("word"))
        .filter("word <> ''")
        .groupBy("word")
        .count()
        .filter("count > 2")
        .orderBy(F.desc("count"), "word")
        .limit(DICTIONARY_WORDS)
        .collect()
    )
    return SecretContext({r["word"]: r["count"] for r in rows})


def candidates(docs: DataFrame, context: SecretContext, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate of every whole text: doc_id, start, end (characters), candidate, before, features."""
    shared = docs.sparkSession.sparkContext.broadcast(context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                for m in CANDIDATE.finditer(text):
                    a, b = m.span()
                    for col, x in zip(cols, (doc, a, b, m.group(), text[max(0, a - CONTEXT) : a], known.features(text, a, b))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cols[0], type=pa.int64()), pa.array(cols[1], type=pa.int32()), pa.array(cols[2], type=pa.int32()),
                    pa.array(cols[3], type=pa.string()), pa.array(cols[4], type=pa.string()),
                    pa.array(cols[5], type=pa.list_(pa.float64())),
                ],
                names=["doc_id", "start", "end", "candidate", "before", "features"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, start int, end int, candidate string, before string, features array<double>"
    )


def fit_forest(findings: DataFrame, label_col: str = "label") -> RandomForestClassificationModel | None:
    """Random forest over labelled candidates, about TRAIN_FINDINGS / 2 of either label at most; None unless both labels occur.

    A sampled finding weighs as many as it stands for, so the share of secrets is that of all findings, however rare.
    """
    given = findings.filter(F.col(label_col).isNotNull()).withColumn("_key", F.concat_ws("/", "doc_id", "start"))
    labelled = bounded_sample(given, "_key", TRAIN_FINDINGS // 2, by=label_col)
    weight = F.lit(1.0)
    for r in given.groupBy(label_col).count().collect():
        weight = F.when(F.col(label_col) == r[label_col], max(1.0, r["count"] / (TRAIN_FINDINGS // 2))).otherwise(weight)
    train = stored(
        labelled.select(array_to_vector("features").alias("x"), F.col(label_col).cast("double").alias("y"), weight.alias("w")).coalesce(8)
    )
    if train.select("y").distinct().limit(2).count() < 2:
        return None
    return RandomForestClassifier(
        featuresCol="x", labelCol="y", weightCol="w", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt"
    ).fit(train)


def scan_secrets(found: DataFrame, forest: RandomForestClassificationModel | None) -> DataFrame:
    """All candidates with `probability` of being a secret and `secret` (probability >= 0.5).

    Texts without candidates (null, empty) give no rows; repeated rows give repeated findings.  Without a forest every
    candidate stays with probability null and secret true: nothing is removed unseen.
    """
    if forest is None:
        return found.select("*", F.lit(None).cast("double").alias("probability"), F.lit(True).alias("secret"))
    scored = forest.transform(found.withColumn("x", array_to_vector("features")))
    chance = F.element_at(vector_to_array("probability"), 2)
    return scored.select(*found.columns, chance.alias("chance")).select(
        *found.columns, F.col("chance").alias("probability"), (F.col("chance") >= 0.5).alias("secret")
    )

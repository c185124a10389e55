"""Small tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

CLASHING = "id string, root string, digest string, row string, node string, key string, start string, n string, norm string, words string, first string, part string"


def sentences(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choice(known) for _ in range(words))


def edge_rows() -> list[tuple]:
    """(doc_id, text): nulls, blanks, copies, near copies, repeated rows and ids, a very long text, shared passages."""
    base, other = sentences(1, 300), sentences(2, 220)
    passage = sentences(3, 80)
    near = base.split()
    near[40], near[170] = "changed", "altered"
    return [
        (5, base), (3, base), (9, " ".join(near)), (3, base), (7, None), (8, ""), (10, " \n\t "), (None, other), (11, other.replace(" ", "\n", 9)),
        (12, sentences(4, 120) + " " + passage + " " + sentences(5, 60)), (13, sentences(6, 30) + " " + passage + " " + sentences(7, 200)),
        (14, "one two"), (15, "One  two"), (16, "x" * 700), (17, "ab" * 300 + "é" * 90), (18, sentences(8, 30_000, 3000)),
        (19, "short text of words here now"), (19, sentences(9, 100)), (20, "日本語のテキスト 日本語のテキスト"),
    ]


def edge_docs(spark, rows=None):
    """The rows as a table with the columns of `documents` and others with names that the operators use inside."""
    sources = [None, "b", "a", "c"]
    full = [
        (d, t, None if i % 5 == 0 else "xx", sources[i % 4], len(t or ""), *["clash"] * 12)
        for i, (d, t) in enumerate(edge_rows() if rows is None else rows)
    ]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)


def no_docs(spark):
    return edge_docs(spark, [])


def shingles(text: str | None) -> Counter:
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a: Counter, b: Counter) -> float:
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common) if common else 0.0


def last_null(doc_id):
    return (doc_id is None, doc_id or 0)


def brute_suffix(rows: list[tuple], length: int = 100) -> dict:
    """(doc_id, n_bytes) and text to (n_removed, n_spans, sha256), for rows that differ in id and text."""
    seen, out = set(), {}
    for doc_id, text in sorted({r for r in rows}, key=lambda r: last_null(r[0])):
        raw, gone = (text or "").encode(), set()
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone.update(range(p, p + length))
            seen.add(w)
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out[doc_id, text] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out

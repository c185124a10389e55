"""Periodic runs, covering SimHash and spelling variants against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyseek.llm import covering, queries, runs, spelling
from tests.llm.fixtures import edge_docs, edge_rows, no_docs, sentences

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=12):
    """Every maximal stretch with a period, by trying each period; the smallest one counts."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if length >= max(least, 2 * q):
                found.setdefault((at, length), q)
            at = end
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_answer(doc_id, text):
    words = SPLIT.findall(text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_runs_of_random_words():
    """Small alphabets, repeated pieces, powers and their neighbours; every least length."""
    rng = random.Random(3)
    texts = []
    for k in range(400):
        words = [rng.choice("ab" if k % 3 else "abcdef") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at, p = rng.randint(0, len(words)), rng.randint(1, 9)
            words[at:at] = [rng.choice("abcd") for _ in range(p)] * rng.randint(2, 5)
        texts.append([w.encode() for w in words])
    for least in (2, 5, 12, 13):
        for words, got in zip(texts, runs.text_runs(texts, least)):
            assert [tuple(r) for r in got.tolist()] == brute_runs(words, least)


def test_suffix_tree_extensions():
    rng = random.Random(4)
    s = [rng.randint(0, 2) for _ in range(120)] + [9]
    tree = runs.Extensions(s)
    assert sorted(range(len(s)), key=lambda i: s[i:]) == [int(i) for i in np.argsort(tree.rank)]
    pairs = [(a, b) for a in range(len(s)) for b in range(len(s)) if a != b]
    got = tree.common(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), common in zip(pairs, got):
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        assert common == k


def run_rows():
    line = "one two three four five six seven eight "
    more = [(i, sentences(i, 30 + i) + " " + line * (i % 4) + sentences(i + 1, 20)) for i in range(100, 160)]
    return [*edge_rows(), *more, (160, "a " * 40_000), (161, "A a " * 9 + "A"), (None, "z " * 15), (162, "x\ty\n" * 6), (162, "x\ty\n" * 6),
            (163, "p q r " * 5 + "in between " + "s " * 14 + "p q r " * 5)]


def test_periodic_runs_query(spark, tmp_path):
    edge_docs(spark, run_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = queries.op11_periodic_runs(spark, str(tmp_path)).select(names).collect()
    expected = [brute_answer(d, t) if len(t or "") < 50_000 else None for d, t in run_rows()]
    long = [r for r in found if r.doc_id == 160]
    assert [(r.n_runs, r.start, r.length, r.period) for r in long] == [(1, 0, 40_000, 1)]
    order = lambda r: (r[0] is None, r[0] or 0, r[7])
    long_ids = {d for d, t in run_rows() if len(t or "") >= 50_000}
    got = sorted((tuple(r) for r in found if r.doc_id not in long_ids), key=order)
    assert got == sorted((e for e in expected if e is not None), key=order)
    assert any(e[1] > 1 for e in expected if e)


def test_periodic_runs_keep_their_texts(spark):
    rows = {(r.doc_id, r.n_words): r for r in runs.periodic_runs(edge_docs(spark, [(1, "q " + "a b " * 8), (2, None), (None, "")]), ["doc_id", "key"]).collect()}
    assert rows[1, 17].collapsed == "q a b" and [tuple(r) for r in rows[1, 17].runs] == [(1, 16, 2)]
    assert rows[2, 0].collapsed == "" and rows[2, 0].runs == [] and rows[None, 0].key == "clash"
    assert runs.periodic_runs(no_docs(spark), ["doc_id"]).collect() == []


def brute_print(text):
    words = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    """print to the smallest print reachable, by comparing all pairs."""
    known, label = sorted(set(prints)), {}
    for p in known:
        if p in label:
            continue
        label[p], open_ = p, [p]
        while open_:
            at = open_.pop()
            for q in known:
                if q not in label and (at ^ q).bit_count() <= radius:
                    label[q] = p
                    open_.append(q)
    return label


def test_fingerprints_are_spark_xxhash64(spark):
    for _, text in edge_rows():
        assert covering.fingerprint((text or "").encode()) == brute_print(text)
    row = spark.range(1).select(F.xxhash64(F.lit("one two éà")).alias("h")).first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest("one two éà".encode(), 42)


def test_masks_cover_every_three_bits():
    import itertools

    masks = covering.covering_masks()
    assert len(masks) == 15 and all(m.bit_count() in (34, 35) or m.bit_count() >= 32 for m in masks)
    for bits in itertools.combinations(range(64), 3):
        change = sum(1 << b for b in bits)
        assert any(not m & change for m in masks)


@pytest.mark.parametrize("bucket", [2048, 5])
def test_links_connect_like_all_pairs(spark, bucket):
    """Dense balls around a few centres and chains of three bits; with small buckets, several rounds of dealing anew."""
    rng = random.Random(6)
    prints = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(60):
            prints.add(at)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                at ^= 1 << b
        ball = rng.getrandbits(64)
        prints |= {ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)}
    prints |= {0, 1, 7, (1 << 64) - 1}
    signed = [covering._signed(p) for p in prints]
    links = covering.near_links(spark.createDataFrame([(p,) for p in signed], "print long").repartition(3), bucket=bucket)
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for r in links.collect():
        a, b = r.a & (1 << 64) - 1, r.b & (1 << 64) - 1
        assert 0 < (a ^ b).bit_count() <= 3
        label[max(root(a), root(b))] = min(root(a), root(b))
    expected = brute_components(prints)
    assert {p: root(p) for p in prints} == expected


def test_near_components_query(spark, tmp_path):
    base = sentences(70, 120).split()
    near = []
    for i in range(120):
        words = list(base)
        for k in range(i % 6):
            words[(17 * i + 29 * k) % len(words)] = f"w{i % 9}"
        near.append((1000 + i, " ".join(words)))
    rows = [*edge_rows(), *near, (None, near[3][1]), (None, "nobody else says this"), (4, "Nobody Else\nsays THIS")]
    edge_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_covering_simhash(spark, str(tmp_path)).collect()
    prints = [brute_print(t) for _, t in rows]
    label = brute_components(prints)
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[label[p]] = min(d, least.get(label[p], d))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = sorted(((d, f"{p:016x}", least.get(label[p])) for (d, _), p in zip(rows, prints)), key=key)
    assert sorted((tuple(r[c] for c in ("doc_id", "fingerprint", "component_id")) for r in found), key=key) == expected
    assert len({e[2] for e in expected}) < len({e[1] for e in expected})
    assert covering.near_components(no_docs(spark)).collect() == []


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(counts, least=3, ratio=2):
    known = {w: n for w, n in counts.items() if n >= least}
    out, forms = {}, {}
    for w, n in known.items():
        near = [v for v in known if brute_near(w, v)]
        best = min(near, key=lambda v: (-known[v], v), default=None)
        forms[w] = best if best is not None and known[best] >= ratio * n else None
        out[w] = (n, len(near))
    rows = []
    for w, (n, n_near) in out.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n, n_near, known.get(forms[w])))
    return sorted(rows)


def spelt(found):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in found.collect())


@pytest.mark.parametrize("crowd", [4096, 3])
def test_spelling_variants_of_random_words(spark, crowd):
    """Tiny alphabets, so that words crowd; with small crowds chunks are halved down to single letters."""
    rng = random.Random(9)
    counts = {}
    for _ in range(900):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(5, 8)))
        counts[word] = rng.choice([1, 2, 3, 4, 7, 8, 16, 30])
    given = spark.createDataFrame([(w, n, "clash") for w, n in counts.items()] + [(None, 9, "clash")], "word string, n long, key string")
    assert spelt(spelling.spelling_variants(given.repartition(3), crowd=crowd)) == brute_spelling(counts)


def test_spelling_query(spark, tmp_path):
    rng = random.Random(10)
    known = ["".join(rng.choice("aeioustrné") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = [*edge_rows(), *[(i, " ".join(rng.choice(known) + rng.choice(["", "", ".", "-X", "É", "×"]) for _ in range(90))) for i in range(200, 260)]]
    rows += [(1, "NAÏVE naïve Naïve nave naive naive naive " * 4), (2, "日本 ½ 123 ab_cdefgh"), (None, "Null ids count as well " * 3)]
    edge_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    expected = brute_spelling(counts)
    assert spelt(queries.op13_spelling(spark, str(tmp_path))) == expected
    assert any(r[1] for r in expected)
    empty = spelling.spelling_variants(spelling.word_counts(no_docs(spark)))
    assert empty.collect() == []

import re
from collections import Counter

import numpy as np
import pytest

from tallyseek.llm import common, near_dedup, passages, shingles, suffix_dedup
from tallyseek.llm.exact_dedup import exact_dedup
from tests.llm.fixtures import brute_suffix, edge_docs, edge_rows, jaccard, last_null, no_docs, sentences
from tests.llm.fixtures import shingles as word_shingles


def test_exact_dedup_on_awkward_rows(spark):
    found = exact_dedup(edge_docs(spark)).collect()
    norm = {}
    for d, t in edge_rows():
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    assert len(found) == len(edge_rows())
    by_size = Counter((r.keep_id, r.group_size) for r in found)
    expected = Counter()
    for ids in norm.values():
        expected[min(ids, key=last_null), len(ids)] += len(ids)
    assert by_size == expected
    assert sum(r.kept for r in found) == len(norm)
    assert len({r.text_sha256 for r in found}) == len(norm)


def test_exact_dedup_group_over_many_ranges(spark):
    """A hot group is split by id and joined up again."""
    rows = [(i, "same  text " + "y" * 60) for i in range(400)] + [(1000 + i, f"other {i}") for i in range(50)]
    found = exact_dedup(edge_docs(spark, rows)).collect()
    hot = [r for r in found if r.group_size == 400]
    assert len(hot) == 400 and {r.keep_id for r in hot} == {0} and sum(r.kept for r in hot) == 1
    assert [r.doc_id for r in hot if r.kept] == [0]


@pytest.mark.parametrize("operator", [exact_dedup, near_dedup.near_dedup, passages.near_passages, suffix_dedup.suffix_dedup])
def test_empty_table(spark, operator):
    assert operator(no_docs(spark)).collect() == []


def test_suffix_dedup_on_awkward_rows(spark):
    rows = edge_rows()
    expected = brute_suffix([r for r in rows if r[0] != 19])
    found = suffix_dedup.suffix_dedup(edge_docs(spark)).collect()
    assert len(found) == len(rows)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found if r.doc_id != 19)
    assert got == Counter((d, *expected[d, t]) for d, t in rows if d != 19)
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed


def test_suffix_dedup_on_random_repeats(spark):
    """Texts over a tiny alphabet, cut from one another at random: overlaps, periods and chains."""
    import random

    rng, texts = random.Random(5), ["ab" * 120, "abc" * 90]
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            source = rng.choice(texts)
            a = rng.randrange(len(source))
            parts.append(source[a : a + rng.randint(40, 260)])
            parts.append("".join(rng.choice("ab c") for _ in range(rng.randint(0, 120))))
        texts.append("".join(parts))
    rows = list(enumerate(texts))
    expected = brute_suffix(rows)
    for r in suffix_dedup.suffix_dedup(edge_docs(spark, rows)).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id, texts[r.doc_id]], r.doc_id


@pytest.mark.parametrize("doc_id", [None, 7])
def test_suffix_dedup_tells_rows_of_one_id_by_their_text(spark, doc_id):
    """Many texts without an id, or with one id, that share a line: no text gets another one's spans, and repeated rows lose the same."""
    line = sentences(31, 30)
    texts = [sentences(100 + i, 40) + " " + line + " " + sentences(900 + i, 25) for i in range(120)]
    rows = [(doc_id, t) for t in texts] + [(doc_id, texts[0])] * 3 + [(1, line)]
    found = suffix_dedup.suffix_dedup(edge_docs(spark, rows)).collect()
    assert len(found) == len(rows)
    mine = [r for r in found if r.doc_id == doc_id]
    # Only the line repeats; with id 7 it comes first in document 1, without an id too, since null ids are last.
    assert all(r.n_spans == 1 and len(line) <= r.n_removed < len(line) + 12 for r in mine)
    raws = Counter(bytes(r.kept) for r in mine)
    assert sum(raws.values()) == 123 and max(raws.values()) == 4 and len(raws) == 120
    assert [r.n_removed for r in found if r.doc_id == 1] == [0]


def test_deep_shallow_orders_and_finds_equals():
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 99, 3000, dtype=np.uint8)) * 2
    starts = rng.integers(0, len(data) - 120, 700)
    lengths = rng.choice([60, 100, 101, 33, 5], 700)
    order, equal = suffix_dedup.deep_shallow(data, starts, lengths)
    strings = [data[starts[i] : starts[i] + lengths[i]] for i in order]
    assert strings == sorted(strings, key=lambda s: (len(s), s))
    assert [False] + [a == b for a, b in zip(strings, strings[1:])] == equal.tolist()


def test_bag_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    for common_, extra, weight in ((80, 20, 1), (50, 50, 3), (30, 5, 40)):
        agree = []
        for seed in range(12):
            items = rng.integers(1, 1 << 47, common_ + 2 * extra, dtype=np.uint64)
            a = np.r_[items[: common_ + extra]]
            b = np.r_[items[:common_], items[common_ + extra :]]
            weights = rng.integers(1, weight + 1, len(items))
            lookup = dict(zip(items.tolist(), weights.tolist()))
            wa, wb = (np.array([lookup[x] for x in s.tolist()]) for s in (a, b))
            wb = np.maximum(1, wb // 2)
            owner = np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)]
            sig = near_dedup.bag_signatures(owner, np.r_[a, b], np.r_[wa, wb], 2)
            ca, cb = Counter(dict(zip(a.tolist(), wa.tolist()))), Counter(dict(zip(b.tolist(), wb.tolist())))
            agree.append((sig[0] == sig[1]).mean() - jaccard(ca, cb))
        assert abs(np.mean(agree)) < 0.04


def test_signature_does_not_depend_on_the_block():
    texts = [sentences(i, 20 + 37 * i).encode() for i in range(12)] + [b"", b"a", b"a " * 5000]

    def signatures(raws):
        hashes, owners, _ = shingles.shingle_hashes(*shingles.word_hashes(raws))
        return near_dedup.bag_signatures(*near_dedup.multisets(hashes, owners), len(raws))

    together = signatures(texts)
    for i, t in enumerate(texts):
        assert (signatures([t])[0] == together[i]).all()


def brute_classes(rows):
    texts = [word_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return Counter((d, min(ids, key=last_null), len(ids)) for ids in groups.values() for d in ids)


def near_rows():
    rows = edge_rows()
    rng = np.random.default_rng(2)
    base = sentences(50, 260).split()
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 260, rng.integers(1, 14)):
            words[at] = f"edit{i}"
        rows.append((100 + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [1000, 7])
def test_near_dedup_agrees_with_all_pairs(spark, monkeypatch, block):
    """Also with a grid of small verification blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", block)
    rows = near_rows()
    found = near_dedup.near_dedup(edge_docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in found) == brute_classes(rows)
    assert sum(r.kept for r in found) == sum(n / size for (_, _, size), n in brute_classes(rows).items())


def test_passages_find_every_repeated_passage(spark):
    rows = [r for r in near_rows() if r[0] is not None]
    texts = dict(rows)
    found = passages.near_passages(edge_docs(spark, rows)).collect()
    listed = {r.doc_id for r in found} | {r.other_id for r in found}
    seen = {}
    for i, (d, t) in enumerate(rows):
        w = (t or "").lower().split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    needed = {rows[i][0] for holders in seen.values() if len(holders) > 1 for i in holders}
    assert needed <= listed and 12 in needed and 13 in needed
    assert not listed & {7, 8, 10, 14, 15, 16, 18, 20}
    for r in found:
        if r.doc_id != 19:
            a = texts[r.doc_id].lower().split()[r.start_word : r.end_word]
            b = texts[r.other_id].lower().split()[r.other_start : r.other_end]
            assert min(len(a), len(b)) >= 50
            assert jaccard(word_shingles(" ".join(a)), word_shingles(" ".join(b))) == pytest.approx(r.similarity)


def test_compact_windows_are_the_tree_nodes():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 50, 400, dtype=np.uint64)
    owner = np.repeat([0, 1, 2], [150, 30, 220])
    got = set(zip(*(x.tolist() for x in passages.compact_windows(values, owner, 9))))
    want = set()
    for c in range(400):
        left = right = c
        while left > 0 and owner[left - 1] == owner[c] and values[left - 1] > values[c]:
            left -= 1
        while right < 399 and owner[right + 1] == owner[c] and values[right + 1] >= values[c]:
            right += 1
        if right - left + 1 >= 9:
            want.add((c, left, right))
    assert got == want


def test_connected_components(spark):
    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(i, i + 1) for i in range(400, 460)] + [(None, 3), (8, 8)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    found = {r.id: r.root for r in common.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in list(root)}


def test_recall_of_near_passages_around_a_common_line(spark):
    """Every two of 120 texts share a near passage (similarity 0.84) around a line that all of them hold: all pairs against brute force."""
    line = sentences(41, 40).split()
    rows = []
    for i in range(120):
        pair = i % 60
        passage = sentences(2000 + pair, 12).split() + line + sentences(3000 + pair, 12).split()
        if i >= 60:
            passage[4 if pair % 2 else -5] = "edited"
        rows.append((i, " ".join(sentences(5000 + i, 30).split() + passage + sentences(7000 + i, 30).split())))
    grams = [word_shingles(" ".join(t.split()[30:94])) for _, t in rows]
    needed = {(i, j) for i in range(120) for j in range(i) if jaccard(grams[i], grams[j]) >= 0.8}
    assert needed == {(i + 60, i) for i in range(60)}
    found = {(r.doc_id, r.other_id) for r in passages.near_passages(edge_docs(spark, rows)).collect()}
    assert found <= needed and len(found) >= 0.9 * len(needed), (len(found), found - needed)


def _hashed(words: list[str]):
    return shingles.shingle_hashes(*shingles.word_hashes([" ".join(words).encode()]), short=False)[0]


@pytest.mark.parametrize("around", [0, 20])
def test_one_edit_at_every_place_of_a_short_passage(around):
    """A passage of 50 to 70 words with one word changed has a similarity of 0.8 or more wherever the word is."""
    for n in (50, 51, 54, 59, 64, 70):
        passage = [f"w{i}" for i in range(n)]
        for k in range(n):
            edited = passage[:k] + ["edited"] + passage[k + 1 :]
            assert jaccard(word_shingles(" ".join(passage)), word_shingles(" ".join(edited))) >= 0.8
            a = [f"a{i}" for i in range(around)] + passage + [f"b{i}" for i in range(around)]
            b = [f"c{i}" for i in range(around + 3)] + edited + [f"d{i}" for i in range(around)]
            x, y = _hashed(a), _hashed(b)
            found = passages.similar_passages(x, y)
            assert found, (n, k)
            for s, t, u, v, alike in found:
                assert min(t - s, v - u) >= passages.LEAST_SHINGLES
                assert alike == passages.weighted_jaccard(x[s:t], y[u:v]) >= 0.8


def test_a_second_passage_is_found_where_the_best_fails():
    """The fullest stretch is scattered over the other text; a passage beside it is not lost."""
    scattered, good = [f"s{i}" for i in range(80)], [f"g{i}" for i in range(60)]
    apart = scattered[:30] + [f"x{i}" for i in range(40)] + scattered[26:56] + [f"y{i}" for i in range(40)] + scattered[52:]
    edited = good[:10] + ["edited"] + good[11:]
    a, b = scattered + ["z1", "z2"] + good, apart + ["q"] * 20 + edited
    found = passages.similar_passages(_hashed(a), _hashed(b))
    assert any(s >= 78 for s, *_ in found)


def test_passages_of_other_lengths_repeat_periodically():
    line = [f"p{i}" for i in range(12)]
    short, long = _hashed(line * 5), _hashed(line * 40)
    assert passages.similar_passages(short, long) and passages.similar_passages(long, short)


def test_every_filling_of_a_template_meets_its_own_copy(spark):
    """Passages of one template, each filling in two documents: all pairs by brute force are connected, verbatim copies first."""
    import random

    rng, template, rows = random.Random(11), sentences(40, 60).split(), []
    for filling in range(40):
        words = list(template)
        words[15], words[38] = f"first{filling}", f"second{filling}"
        for copy in range(2):
            around = [" ".join(f"d{filling}x{copy}x{side}x{i}" for i in range(25)) for side in range(2)]
            rows.append((filling, " ".join([around[0], *words, around[1]])))
    rng.shuffle(rows)
    fillings = [f for f, _ in rows]
    docs = [(i, t) for i, (_, t) in enumerate(rows)] + [(900, sentences(41, 30) + " " + rows[0][1] + " " + sentences(42, 30) + " " + rows[1][1])]
    found = passages.near_passages(edge_docs(spark, docs)).collect()
    links = {(r.doc_id, r.other_id) for r in found} | {(r.other_id, r.doc_id) for r in found}
    for i, f in enumerate(fillings):
        twin = next(k for k, g in enumerate(fillings) if g == f and k != i)
        assert (i, twin) in links or any((i, k) in links and (k, twin) in links for k in range(len(docs))), (i, twin)
    texts = dict(docs)
    for r in found:
        a, b = texts[r.doc_id].lower().split()[r.start_word : r.end_word], texts[r.other_id].lower().split()[r.other_start : r.other_end]
        assert min(len(a), len(b)) >= 50
        assert jaccard(word_shingles(" ".join(a)), word_shingles(" ".join(b))) == pytest.approx(r.similarity) and r.similarity >= 0.8

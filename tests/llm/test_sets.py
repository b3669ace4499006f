import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinfold.llm import interleave, ngramjoin, posindex, suffixes
from tests.llm import cases


def test_interleave(spark):
    extra = [(1000 + k, f"t{k}") for k in range(500)]
    docs = cases.documents(spark, extra=extra)
    rows = interleave.stratified_interleave(docs, n_shards=7, bucket_rows=16).collect()
    assert len(rows) == docs.count()
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    sizes = [len(v) for v in shards.values()]
    assert set(shards) == set(range(7)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    source = {(r.doc_id, r.text): r.source for r in docs.collect()}
    text_of = {(r.doc_id, zlib.crc32((r.text or "").encode())): r.text for r in docs.collect()}
    mix = defaultdict(lambda: [0] * 7)
    for r in rows:
        text = text_of[(r.doc_id, r.text_crc32)]
        assert r["size"] == len((text or "").encode()) + 8 and r.law == "rows" and r.grown_shard is None
        mix[source[(r.doc_id, text)]][r.shard] += 1
    assert all(max(v) - min(v) <= 2 for v in mix.values())
    assert interleave.stratified_interleave(cases.empty(spark)).count() == 0


def shingles(text, n):
    words = [w for w in text.encode().translate(ngramjoin.FOLD).split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if len(words) >= n else frozenset([tuple(words)])


def brute_classes(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(sets[i]), d if not sets[i] else low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("n, percent, group_rows, group_grams", [(4, 85, 2000, 2_000_000), (2, 60, 3, 2_000_000), (5, 80, 2000, 2_000_000), (3, 70, 2000, 40)])
def test_jaccard_classes(spark, n, percent, group_rows, group_grams):
    rng = random.Random(9)
    base = cases.prose(rng, 60).split()
    extra = []
    for k in range(30):  # a large group of near copies
        words = [*base]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = rng.choice(cases.WORDS)
        extra.append((100 + k, " ".join(words)))
    docs = cases.documents(spark, extra=extra)
    got = sorted(map(tuple, ngramjoin.jaccard_classes(docs, n, percent, group_rows=group_rows, group_grams=group_grams).collect()), key=str)
    assert got == brute_classes(cases.pairs(docs), n, percent)


@pytest.mark.parametrize("group_rows", [2000, 3])
def test_every_link(spark, group_rows):
    rng = random.Random(9)
    base = cases.prose(rng, 60).split()
    extra = []
    for k in range(30):
        words = [*base]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = rng.choice(cases.WORDS)
        extra.append((100 + k, " ".join(words)))
    docs = cases.documents(spark, extra=extra)
    rows = cases.pairs(docs)
    sets = [shingles(t, 2) for _, t in rows]
    distinct = list({s for s in sets if s})
    linked = lambda a, b: 100 * len(a & b) >= 60 * len(a | b)
    first = lambda s: min(d for (d, _), own in zip(rows, sets) if own == s and d is not None)
    want = sorted(tuple(sorted((first(a), first(b)))) for i, a in enumerate(distinct) for b in distinct[:i] if linked(a, b))
    got = sorted(tuple(sorted((r.a_id, r.b_id))) for r in ngramjoin.jaccard_links(docs, 2, 60, group_rows=group_rows).collect())
    assert got == want and len(want) > 100
    counts = sorted(map(tuple, ngramjoin.link_counts(docs, 2, 60, group_rows=group_rows).collect()), key=str)
    assert counts == sorted(((d, sum(linked(s, o) for o in distinct if o != s) if s else 0) for (d, _), s in zip(rows, sets)), key=str)


def test_jaccard_of_nothing(spark):
    assert ngramjoin.jaccard_classes(cases.empty(spark)).count() == 0


LEVELS = np.zeros(1 << ngramjoin.SKETCH_BITS, dtype=np.uint8)


def tree_pairs(sets, percent, levels=LEVELS):
    tree = ngramjoin.PrefixTree(sets, levels)
    return sorted((tree.order[x], tree.order[y]) for x, linked in tree.links(percent) for y in linked.tolist())


def test_prefix_tree_finds_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.integers(0, 50, 30)
        sets = [np.unique(np.where(rng.random(30) < 0.1, rng.integers(0, 60, 30), base)[: rng.integers(1, 31)]) for _ in range(25)]
        sets = [s.astype(np.int64) << 44 for s in {tuple(s): s for s in sets}.values()]
        levels = rng.integers(0, 3, 1 << ngramjoin.SKETCH_BITS).astype(np.uint8)
        want = []
        for i in range(len(sets)):
            for j in range(len(sets)):
                both = len(np.intersect1d(sets[i], sets[j]))
                if i != j and 100 * both >= 70 * (len(sets[i]) + len(sets[j]) - both):
                    want.append((i, j))
        assert tree_pairs(sets, 70, levels) == want


def test_unlinked_sets_are_left_early():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**62, 60)) for _ in range(2000)]
    began = time.process_time()
    assert tree_pairs(sets, 85) == []
    assert time.process_time() - began < 2


@pytest.mark.parametrize("group_rows", [200, 5])
def test_one_row_of_each_class_stays(spark, group_rows):
    rng = random.Random(9)
    base = cases.prose(rng, 60)
    near = base.replace("alpha", "omega", 1) + " end"
    extra = [(1, base), (1, base), (2, base), (2, cases.prose(rng, 50)), (None, near), (None, near), (None, None), (None, cases.prose(rng, 40))]
    for k in range(30):
        words = base.split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = rng.choice(cases.WORDS)
        extra.append((100 + k, " ".join(words)))
    docs = cases.documents(spark, extra=extra)
    rows = cases.pairs(docs)
    sets = [shingles(t, 5) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    kept = ngramjoin.keep_first(docs, group_rows=group_rows)
    assert kept.columns == docs.columns
    got = cases.pairs(kept)
    classes = [r for r, s in zip(root, sets) if s]
    blank = [r for r, s in zip(rows, sets) if not s]
    assert len(got) == len(set(classes)) + len(blank)
    smallest = Counter(min((d for (d, _), r in zip(rows, root) if r == k and d is not None), default=None) for k in set(classes))
    assert Counter(d for d, _ in got) == smallest + Counter(d for d, _ in blank)
    assert not Counter(got) - Counter(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 20)] + [(100, 101), (103, 101), (7, 3)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in links], "a binary, b binary")
    got = {r.node[0]: r.root[0] for r in ngramjoin.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, 101: 100, 103: 100}


def brute_removed(rows, length):
    """Documents in order of id and crc; equal rows are one document."""
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()))
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=key):
        raw = text.encode()
        cover = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                cover[p : p + length] = True
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out[(doc_id, text)] = (doc_id, len(raw), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[r] for r in rows), key=str)


@pytest.mark.parametrize("sizes", [{}, {"group_anchors": 5}, {"block_anchors": 4}])
def test_repeats_removed(spark, sizes):
    docs = cases.documents(spark)
    got = sorted(map(tuple, suffixes.remove_repeats(docs, **sizes).collect()), key=str)
    assert got == brute_removed(cases.pairs(docs), 100)


def test_nothing_removed_from_nothing(spark):
    assert suffixes.remove_repeats(cases.empty(spark)).count() == 0


def test_suffix_array_and_anchors():
    rng = random.Random(5)
    for _ in range(150):
        length = rng.choice([8, 9, 12, 20, 33])
        signs = rng.choice(["ab", "abc\0", "abcdefgh"])
        base = "".join(rng.choice(signs) for _ in range(200))
        bodies = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randint(0, 150)
            bodies.append(("".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) + base[a : a + rng.randint(5, 80)]).encode())
        seen, want = set(), []
        for b in bodies:
            own = []
            for p in range(len(b) - length + 1):
                if b[p : p + length] in seen:
                    own.append(p)
                seen.add(b[p : p + length])
            want.append(own)
        assert [x.tolist() for x in suffixes.repeats(bodies, length)] == want
        raw = b"".join(bodies)
        at = set(suffixes.anchors(raw, 20, 8)[0].tolist())
        assert all(any(p <= a <= p + 12 for a in at) for p in range(len(raw) - 19))


def brute_contaminated(rows, items, reach=posindex.REACH):
    windows = defaultdict(set)
    for item_id, text in items:
        words = posindex.words(text or "")
        for k in range(max(1, len(words) - 12)) if words else ():
            windows[tuple(words[k : k + 13])].add(str(item_id))
    total = Counter(w for _, text in rows for w in posindex.words(text))
    rarest = {win: min((total[w], w) for w in win)[1] for win in windows if all(total[w] for w in win)}
    out = []
    for doc_id, text in rows:
        words, hit, found, near = posindex.words(text), set(), set(), set()
        for n in {len(w) for w in windows}:
            for p in range(len(words) - n + 1):
                owners = windows.get(tuple(words[p : p + n]))
                if owners:
                    hit |= set(range(p, p + n))
                    found |= owners
        for win, rare in rarest.items():
            if any(w == rare and set(win) <= set(words[max(0, p - reach) : p + reach + 1]) for p, w in enumerate(words)):
                near |= windows[win]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(words), len(near)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_windows", [1 << 24, 5])
def test_contamination(spark, block_windows, monkeypatch):
    monkeypatch.setattr(posindex, "SEGMENT_WORDS", 150)
    rng = random.Random(6)
    items = [(k, cases.prose(rng, rng.choice([1, 3, 12, 13, 20, 40]))) for k in range(12)] + [(50, None), (51, ""), (52, "word"), (None, "alpha")]
    extra = [(200 + k, f"{cases.prose(rng, k)} {items[k % 12][1].title()}, {cases.prose(rng, 9 * k)}") for k in range(12)]
    docs = cases.documents(spark, extra=extra)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = posindex.contamination(docs, bench, block_windows=block_windows)
    assert sorted(map(tuple, got.collect()), key=str) == brute_contaminated(cases.pairs(docs), [i for i in items if i[0] is not None])
    kept = posindex.drop_contaminated(docs, bench)
    bad = {r[0] for r in got.filter("contaminated").select("doc_id").collect()}
    assert kept.columns == docs.columns and len(bad) > 5
    assert Counter(cases.pairs(kept)) == Counter(r for r, b in zip(cases.pairs(docs), brute_flags(cases.pairs(docs), [i for i in items if i[0] is not None])) if not b)
    if block_windows > 5:
        assert posindex.contamination(cases.empty(spark), bench).count() == 0
        none = posindex.contamination(docs, bench.limit(0)).filter("n_hit > 0 or contaminated or n_near > 0").count()
        assert none == 0


def brute_flags(rows, items):
    total = brute_contaminated(rows, items)
    flags = {(r[0], r[1], r[2]): r[5] for r in total}
    assert len({(r[0], r[1]) for r in total}) == len(flags)
    by_size = {(r[0], r[1]): r[5] for r in total}
    return [by_size[d, len(posindex.words(t))] for d, t in rows]


def test_proximity(spark):
    docs = cases.documents(spark, extra=[(900, "quick red fox near a lazy dog"), (901, "quick " + "pad " * 9 + "dog")])
    items = spark.createDataFrame([(1, "dog quick")], "item_id long, text string")
    index = posindex.build_index(docs)
    near = lambda reach: {r.doc_id for r in posindex.proximity_matches(index, items, reach).collect()}
    assert near(6) == {900} and near(10) == {900, 901} and near(2) == set()

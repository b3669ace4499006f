import functools
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import decisionlist, gam, skipchain, textstats, toxicity
from tests.llm import cases

KIND = "doc_id long, quality int, toxic int"


def corpus(spark, n=240):
    """Half with junk, a third with insults; labels with nulls and strangers."""
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(2000, 2000 + n):
        junk, foul = k % 2 == 0, k % 3 == 0
        words = cases.prose(rng, rng.randint(60, 90)).split()
        words = [f"{w}{k}{i}" if i % 2 else w for i, w in enumerate(words)]
        if foul:
            for term in ("idiot", "worthles", "glorpish"):
                words.insert(rng.randrange(len(words)), term)
        if junk:
            words = [w + "%%$" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not junk), int(foul)))
    labels += [(5, None, None), (99_999, 1, 1)]
    return cases.documents(spark, extra=rows), spark.createDataFrame(labels, KIND)


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus(spark)
    return docs.persist(), labels.persist()


def crc_fold(doc_id, mod, remainder):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % mod == remainder


def accuracy(rows, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_quality(spark, learned):
    docs, labels = learned
    rows = gam.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == crc_fold(r.doc_id, 3, 1) for r in rows)
    assert accuracy(rows, labels, "quality") > 0.95


def test_toxicity(spark, learned):
    docs, labels = learned
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == crc_fold(r.doc_id, 5, 0) for r in rows)
    assert accuracy(rows, labels, "toxic") > 0.95


def test_without_labels_or_documents(spark, learned):
    docs, labels = learned
    none = labels.limit(0)
    for scored in (gam.quality_scores(docs, none), toxicity.toxicity_scores(docs, none)):
        assert {r.score for r in scored.collect()} == {0.5}
    kept = decisionlist.quality_rules(docs, none)
    assert kept.filter("kept = base_failed").count() == 0
    nothing = cases.empty(spark)
    for made in (gam.quality_scores(nothing, labels), toxicity.toxicity_scores(nothing, labels), decisionlist.quality_rules(nothing, labels), skipchain.personal_data(nothing)):
        assert made.count() == 0


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = gam.fit(x, y)
    assert m.pairs[0] == (0, 1) and ((m.score(x) >= 0.5) == y).mean() > 0.9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton():
    rng = random.Random(1)
    terms = ["abcabc", "abc", "bbbbbbb", "cabba"]
    trie = toxicity.Trie(terms)
    lexicon = toxicity.Lexicon(terms, ["ccc"])
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        near = [(distance(word, t), t) for t in terms if distance(word, t) <= 1]
        found = toxicity.intersect(trie, toxicity.Levenshtein(word, 1))
        assert found == (None if not near else (min(near)[1], min(near)[0]))
        kind = 1 if word in terms else 3 if word.startswith("ccc") else 2 if any(distance(word, t) <= 1 for t in terms if len(t) >= 6) else 0
        assert lexicon.kind(word) == kind


def swapped(a, b):
    """Distance with neighbours exchanged as one edit."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_short_terms_and_stems_are_met_misspelt():
    rng = random.Random(2)
    terms, stems = ["abcabc", "abca", "bbbbb", "cabbacab"], ["ccac"]
    lexicon = toxicity.Lexicon(terms, stems, least=4)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
        near = any(swapped(word, t) <= (2 if len(t) >= 8 else 1) for t in terms)
        near = near or any(swapped(word[:k], t) <= 1 for t in stems for k in range(len(word) + 1))
        assert (lexicon.kind(word) > 0) == near


def test_documents_of_misspelt_insults():
    texts = ["one idiott two morron three scumm", "tarsh lsoer duumb clowm", "pahtetci worhtles filhty", "plain words alone"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    rows = next(toxicity.extractor(toxicity.TERMS, [])(iter([batch])))
    assert rows.column("hits").to_pylist() == [3, 4, 3, 0]


def test_quotation_counts_for_less():
    lexicon = toxicity.Lexicon(toxicity.TERMS, [])
    score = lambda t: lexicon.features(t)[toxicity.FEATURES.index("score")]
    plain = score("one two idiot three")
    assert score('one said "two idiot" three') < plain < score("one you idiot three")
    assert score("") == 0


def brute_counts(text):
    spaces = " \t\n\x0b\x0c\r"
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if any(c not in spaces for c in x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_rules(spark, learned):
    docs, labels = learned
    rows = decisionlist.quality_rules(docs, labels).collect()
    text = Counter((i, *brute_counts(t)) for i, t in cases.pairs(docs))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == text
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good = [r.kept for r in rows if truth.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if truth.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.05


def test_counts_of_odd_texts():
    for t in ("", " ", "a\na\na\n\n \n", "x y z x y z x y z", "  a b", "#*$%&|<> ü", "a b a b a b"):
        assert textstats.counts(t)[:5] == brute_counts(t)


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for pattern, kind in ((r"[0-9]([\x20-]?[0-9])+", 2), (r"\+[0-9][\x20().0-9-]+[0-9]", 3)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if (14 <= len(d) <= 19 and skipchain.luhn(d)) if kind == 2 else 10 <= len(d) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(1)
    signs = ["a", "b.", "@", "@", ".", "1", "22", "255", "256", "+", "-", " ", "(", "4", "0", "4467920212765298", "a@b.c", "\n", "é", "1.2.3.4"]
    for _ in range(8000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(1, 25)))
        assert skipchain.base_spans(t)[0] == brute_spans(t)


LETTER = "Write to jane.doe7@mail.example.org today. Later jane.doe7 answered, and +1 (555) 010-2345 too; card 4467920212765298."


def test_personal_data(spark):
    rows = [(700 + k, f"{LETTER} {k}") for k in range(20)] + [(800, "1.2.3.4 is an address, 1.2.3.999 is not")]
    docs = cases.documents(spark, extra=rows)
    got = skipchain.personal_data(docs).collect()
    text = Counter()
    for i, t in cases.pairs(docs):
        base = brute_spans(t)
        text[(i, *(sum(k == j for _, k, _ in base) for j in range(4)), hashlib.sha256(skipchain.listed(base).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == text
    one = next(r for r in got if r.doc_id == 700)
    at = LETTER.index("jane.doe7 answered")
    assert f"email:{at}:{at + 9}" in one.spans and one.n_added == 1
    assert next(r for r in got if r.doc_id == 800).spans == "ip:0:7"


def test_redaction(spark):
    docs = cases.documents(spark, extra=[(700 + k, f"{LETTER} {k}") for k in range(5)])
    out = {(r.doc_id, r.n_chars): r.text for r in skipchain.redact(docs).collect()}
    assert out[(700, None)] == "Write to [email] today. Later [email] answered, and [phone] too; card [card]. 0"
    assert skipchain.redact(docs).columns == docs.columns and out[(40, None)] is None


def exact(field, found):
    """Marginals by summing over all labellings."""
    own = np.array([x.shape for x in found]) @ field.weights
    pairs = [(i, j, field.chain) for i, j in skipchain.chains(found, field.reach)] + [(i, j, field.skip) for i, j in skipchain.skips(found)]
    total = np.zeros((len(found), 5))
    for labels in itertools.product(range(5), repeat=len(found)):
        if all(x.label in (None, y) for x, y in zip(found, labels)):
            weight = math.exp(sum(own[i, y] for i, y in enumerate(labels)) + sum(w for i, j, w in pairs if labels[i] == labels[j]))
            for i, y in enumerate(labels):
                total[i, y] += weight
    return total / total.sum(1, keepdims=True)


def test_messages_against_all_labellings():
    """On a tree message passing is exact, on loops it is near and decides alike."""
    field = skipchain.fit([])
    tree = skipchain.nodes("jane.doe7@mail.example.org and then jane.doe7 again")
    assert len(tree) == 2 and skipchain.skips(tree) == [(0, 1)]
    assert np.allclose(field.marginals(tree, rounds=60), exact(field, tree), atol=1e-3)
    rng = np.random.default_rng(1)
    for text in ("jane.doe7@mail.example.org jane.doe7 jane.doe7 and jane.doe7 555-0100-22", "1.2.3.999 +1 2 1.2.3.999 a@b 1.2.3.999", "bob_1990@x.org, bob_1990@y.com, bob_1990 5550100222"):
        found = skipchain.nodes(text)
        assert len(skipchain.skips(found)) >= 2
        for _ in range(5):
            loose = skipchain.Field(rng.normal(0, 1, field.weights.shape), 0.2, 1.5)
            want, got = exact(loose, found), loose.marginals(found, rounds=200)
            assert np.abs(want - got).max() < 0.15
            sure = want.max(1) > 0.7
            assert (want.argmax(1) == got.argmax(1))[sure].all()


def test_weights_are_learned_together():
    """Skips that always agree raise their weight, chains that never do lower theirs."""
    rows = []
    for label in (0, 1):
        own = [0.0] * (len(skipchain.SHAPES) - 1) + [1.0]
        agree, other = [float(k == label) for k in range(5)], [float(k == 1 - label) for k in range(5)]
        rows.append((own, other, agree, label, 50))
    field = skipchain.fit(rows)
    assert field.skip > skipchain.LINKS[1] and field.chain < skipchain.LINKS[0]


def test_long_texts_take_linear_time():
    field = skipchain.fit([])
    token = "x" * 1_000_000 + "@"
    refused = " ".join(f"999.{k % 300}.999.1" for k in range(50_000))
    names = " ".join(f"name.{k}@mail.example.org name.{k}" for k in range(20_000))
    for text, most in ((token, 2), (refused, 8), (names, 15)):
        began = time.process_time()
        skipchain.nodes(text)
        assert time.process_time() - began < most
    assert field.spans(token) == ([], [])


def test_queries_against_plain_loops(spark, learned):
    """Scores by look-up from the model's own tables, and the first rule that a row meets."""
    docs, labels = learned
    rows = textstats.training_rows(docs, labels, "quality", 3, 1, 20_000)
    x, y = rows[textstats.FEATURES].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float)
    held = {r.doc_id for r in labels.collect() if r.quality is not None and crc_fold(r.doc_id, 3, 1)}
    assert set(rows["doc_id"]) & held == set() and len(rows) > 100
    model = gam.fit(x, y)
    plain = textstats.with_ratios(textstats.text_counts(docs.select("doc_id", "text"))).toPandas()

    def score(r):
        total = model.intercept
        for j, name in enumerate(textstats.FEATURES):
            total += model.tables[j][sum(r[name] >= c for c in model.edges[j])]
        for (a, b), table in zip(model.pairs, model.pair_tables):
            u, v = (sum(r[textstats.FEATURES[j]] >= c for c in model.pair_edges[j]) for j in (a, b))
            total += table[u, v]
        return round(1 / (1 + math.exp(-total)), 9)

    want = Counter((None if math.isnan(r["doc_id"]) else int(r["doc_id"]), score(r)) for _, r in plain.iterrows())
    assert Counter((r.doc_id, round(r.score, 9)) for r in gam.quality_scores(docs, labels).collect()) == want
    rules = decisionlist.learn({c: rows[c].to_numpy(dtype=float) for c in textstats.FEATURES}, y == 0)

    def fired(r):
        for k, rule in enumerate(rules, 1):
            if all(r[t.feature] > t.value if t.above else r[t.feature] <= t.value for t in rule):
                return k
        return 0

    want = Counter((None if math.isnan(r["doc_id"]) else int(r["doc_id"]), fired(r)) for _, r in plain.iterrows())
    assert rules and Counter((r.doc_id, r.rule) for r in decisionlist.quality_rules(docs, labels).collect()) == want


def test_toxicity_against_plain_loops(spark, learned):
    """Hits by the distance to every term, and rows that go by their texts alone."""
    docs, labels = learned
    terms, stems, model = toxicity.train(docs, labels, "toxic", 5, 0, 20_000)
    near = lambda w, t: swapped(w, t) <= toxicity.edits(len(t))

    @functools.cache
    def hit(w):
        return any(w == t or len(t) >= 4 and near(w, t) for t in terms) or any(w.startswith(t) or len(t) >= 4 and any(near(w[:k], t) for k in range(len(w) + 1)) for t in stems)

    rows = toxicity.toxicity_scores(docs, labels).collect()
    text = Counter()
    for i, t in cases.pairs(docs):
        words = [w.strip(toxicity.EDGE) for w in t.lower().split()][:200]
        text[i, len(t.split()) <= 200 and sum(map(hit, words))] += 1
    short = {i for i, t in cases.pairs(docs) if len(t.split()) <= 200}
    got = Counter((r.doc_id, r.n_hits) for r in rows if r.doc_id in short)
    assert got == Counter({k: n for k, n in text.items() if k[0] in short})
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    toxic = Counter(r.doc_id for r in rows if r.predicted)
    assert Counter(i for i, _ in cases.pairs(kept)) == Counter(i for i, _ in cases.pairs(docs)) - toxic and toxic

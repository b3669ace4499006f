"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

A word meets the lexicon when the Levenshtein automaton of the word and the trie of
terms, walked together, reach a final state on both sides; terms learned as stems may
be followed by anything. Each hit is scored by the words around it: inside quotation
marks or after a verb of reporting it counts for little, beside a word of address for
more. An additive model turns a document's hits into a score.

Terms and stems of ``LEAST`` letters or more are met with one edit, of eight with two,
neighbours exchanged being one edit; such looser hits weigh less. The product of all these
automata with the trie is made deterministic as words are read (``Product``), so a word
costs a look-up a letter until nothing is left that it could become, and each distinct word
of a task is read once.

The lexicon is a short public list, extended by words and stems that the labelled rows
show to be typical of label 1. Learned from at most ``max_labelled`` labelled rows
outside the held-out fold; all rows and whole texts are scored. Defined results: null
and empty texts are scored as texts without hits; without labels, or with one class
only, the score is the (smoothed) share of label 1; repeated rows and rows with equal texts
are scored alike, whatever their ids; a score of exactly one half counts as toxic; an
empty table gives no rows; other columns are ignored, and kept by ``drop_toxic``.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import gam
from kinfold.llm.common import bounded_batches, discard, held_out, materialize, texts, tidy
from kinfold.llm.textstats import labelled

MAX_LABELLED = 20_000
MEMO = 200_000
EDGE = ".,;:!?\"'()[]{}|%*&$#<>-_~`«»“”„‘’"
QUOTES = '"“”„«»'

# Seed terms, words of reporting and words of address.
TERMS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb filthy vermin imbecile retard bastard".split()
REPORTING = frozenset("said says wrote writes called quoted quote quotes cited reported word term dit écrit schrieb sagte dijo escribió".split())
ADDRESS = frozenset("you your you're u du dein tu tes vous usted tú".split())

LEAST = 4  # letters of the shortest terms and stems whose misspellings count
WEIGHT = {2: 0.7, 4: 0.4}  # of a hit that is not the term itself

FEATURES = "hits near stems score densest quoted addressed log_words per_100".split()


class Trie:
    """Terms as nested nodes; ``stem`` marks those that any ending may follow."""

    def __init__(self, terms: list[str], stems: list[str] = ()):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        for kind, entries in ((self.word, terms), (self.stem, stems)):
            for entry in entries:
                at = 0
                for ch in entry:
                    if ch not in self.next[at]:
                        self.next[at][ch] = len(self.next)
                        self.next.append({})
                        self.word.append(None)
                        self.stem.append(None)
                    at = self.next[at][ch]
                kind[at] = entry

    def stem_of(self, word: str) -> str | None:
        at = 0
        for ch in word:
            at = self.next[at].get(ch, -1)
            if at < 0:
                return None
            if self.stem[at] is not None:
                return self.stem[at]
        return None


class Levenshtein:
    """The automaton of all words within ``most`` edits of ``word``; states are rows of distances."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most

    def start(self) -> tuple[int, ...]:
        return tuple(range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], ch: str) -> tuple[int, ...]:
        out = [state[0] + 1]
        for k, c in enumerate(self.word):
            out.append(min(out[k] + 1, state[k] + (c != ch), state[k + 1] + 1))
        return tuple(out)

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.most

    def final(self, state: tuple[int, ...]) -> bool:
        return state[-1] <= self.most


def intersect(trie: Trie, automaton: Levenshtein) -> tuple[str, int] | None:
    """The nearest (then first) whole term that both accept, with its distance."""
    best, stack = None, [(0, automaton.start())]
    while stack:
        at, state = stack.pop()
        term = trie.word[at]
        if term is not None and automaton.final(state):
            found = (state[-1], term)
            best = found if best is None else min(best, found)
        for ch, to in trie.next[at].items():
            after = automaton.step(state, ch)
            if automaton.alive(after):
                stack.append((to, after))
    return None if best is None else (best[1], best[0])


def edits(length: int) -> int:
    """How many edits a word may be away from a term of ``length`` letters."""
    return 2 if length >= 8 else 1


class Product:
    """The words within ``edits`` of a trie's terms, or that begin so with one of its stems.

    A state is the set of places that the letters read so far can be at: (node, edits made,
    letter still owed by two exchanged neighbours). States and their successors are kept
    as they are met; letters that no term has are all one.
    """

    ACCEPTED = 1
    MOST = 50_000  # states kept; beyond, they are made again

    def __init__(self, trie: Trie):
        self.trie = trie
        self.letters = {ch for node in trie.next for ch in node}
        self.room = [-1] * len(trie.next)  # edits that any term below a node allows
        for at in reversed(range(len(trie.next))):
            own = [edits(len(t)) for t in (trie.word[at], trie.stem[at]) if t is not None]
            self.room[at] = max([*own, *(self.room[to] for to in trie.next[at].values())], default=-1)
        self.clear()

    def clear(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.places: list[frozenset] = []
        self.after: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.state(frozenset())  # 0: nothing left
        self.state(frozenset([(-1, 0, "")]))  # 1: a stem has been met, anything may follow
        self.begin = self.state(self.closed([(0, 0, "")]))

    def closed(self, places) -> frozenset:
        """With the letters that the word may leave out; of places at one node the one with fewest edits."""
        best: dict[tuple[int, str], int] = {}
        todo = list(places)
        while todo:
            at, made, owed = todo.pop()
            if made > self.room[at] or best.get((at, owed), 9) <= made:
                continue
            best[at, owed] = made
            if not owed:
                todo += [(to, made + 1, "") for to in self.trie.next[at].values()]
        return frozenset((at, made, owed) for (at, owed), made in best.items())

    def state(self, places: frozenset) -> int:
        found = self.number.get(places)
        if found is None:
            found = self.number[places] = len(self.places)
            self.places.append(places)
            self.after.append({})
            word = self.trie.word
            self.final.append(any(at < 0 or not owed and word[at] is not None and made <= edits(len(word[at])) for at, made, owed in places))
        return found

    def step(self, state: int, ch: str) -> int:
        out = []
        for at, made, owed in self.places[state]:
            if owed:
                if ch == owed:
                    out.append((at, made, ""))
                continue
            below = self.trie.next[at]
            if ch in below:
                out.append((below[ch], made, ""))
            out.append((at, made + 1, ""))
            for other, to in below.items():
                out.append((to, made + 1, ""))
                if other != ch and ch in self.trie.next[to]:
                    out.append((self.trie.next[to][ch], made + 1, other))
        places = self.closed(out)
        return self.ACCEPTED if self.has_stem(places) else self.state(places)

    def has_stem(self, places) -> bool:
        stem = self.trie.stem
        return any(not owed and stem[at] is not None and made <= edits(len(stem[at])) for at, made, owed in places)

    def accepts(self, word: str) -> bool:
        at, after = self.begin, self.after
        for ch in word:
            if ch not in self.letters:
                ch = ""
            to = after[at].get(ch)
            if to is None:
                to = after[at][ch] = self.step(at, ch)
            if to <= 1:
                return to == 1
            at = to
        found = self.final[at]
        if len(self.places) > self.MOST:
            self.clear()
        return found


class Lexicon:
    """Looks words up: 0 none, 1 a term, 2 within one edit of one of six letters or more, 3 a stem.

    With ``least``, also 4: a looser match of a term or stem of that many letters or more, by
    ``edits`` of its length, neighbours exchanged being one edit.
    """

    def __init__(self, terms: list[str], stems: list[str], fuzzy: int = 6, least: int | None = None):
        self.trie = Trie(terms, stems)
        self.terms = frozenset(terms)
        self.fuzzy = fuzzy
        long = [t for t in terms if len(t) >= fuzzy]
        self.lengths = {n + k for n in map(len, long) for k in (-1, 0, 1)}
        self.heads = {(len(t) // 2, t[: len(t) // 2]) for t in long}
        self.tails = {(len(t) - len(t) // 2, t[len(t) // 2 :]) for t in long}
        self.head_sizes = sorted({n for n, _ in self.heads})
        self.tail_sizes = sorted({n for n, _ in self.tails})
        self.loose = None if least is None else Product(Trie([t for t in terms if len(t) >= least], [t for t in stems if len(t) >= least]))
        self.hit: dict[str, int] = {}  # what was met lately, and its kind
        self.clean: set[str] = set()  # and what is no hit

    def kind(self, word: str) -> int:
        loose = self.loose is not None and self.loose.accepts(word)
        if word in self.terms:
            return 1
        if self.trie.stem_of(word) is not None:
            return 3
        if self.loose is not None and not loose and self.fuzzy >= LEAST:
            return 0
        if len(word) in self.lengths and (any((k, word[:k]) in self.heads for k in self.head_sizes) or any((k, word[-k:]) in self.tails for k in self.tail_sizes)):
            found = intersect(self.trie, Levenshtein(word, 1))
            if found is not None and len(found[0]) >= self.fuzzy:
                return 2
        return 4 if loose else 0

    def read(self, words: set[str]) -> None:
        """Tell which of ``words`` are hits."""
        if len(self.clean) > MEMO:
            self.clean = set()
        if len(self.hit) > MEMO:
            self.hit = {}
        for chunk in words.difference(self.clean).difference(self.hit):
            kind = self.kind(chunk.strip(EDGE))
            if kind:
                self.hit[chunk] = kind
            else:
                self.clean.add(chunk)

    def all_features(self, texts: list[str], at_once: int = 1 << 20) -> list[tuple[float, ...]]:
        """``features`` of each text; the words of texts of ``at_once`` signs are looked up together."""
        out: list[tuple[float, ...]] = []
        held: list[list[str]] = []
        rows: list[str] = []
        signs = 0
        for k, text in enumerate(texts):
            rows.append(text)
            held.append(text.lower().split())
            signs += len(text)
            if signs >= at_once or k == len(texts) - 1:
                self.read(set().union(*held))
                out += map(self.of_words, rows, held)
                held, rows, signs = [], [], 0
        return out

    def features(self, text: str) -> tuple[float, ...]:
        return self.all_features([text])[0]

    def of_words(self, text: str, words: list[str], reach: int = 6) -> tuple[float, ...]:
        n, hit = len(words), self.hit
        if hit.keys().isdisjoint(words):
            return (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, math.log1p(n), 0.0)
        hits = [(i, hit[w]) for i, w in enumerate(words) if w in hit]
        marks = np.cumsum([sum(w.count(q) for q in QUOTES) if any(q in w for q in QUOTES) else 0 for w in words]) if any(q in text for q in QUOTES) else None
        score = quoted = addressed = near = stems = 0.0
        at = np.array([i for i, _ in hits])
        for i, kind in hits:
            around = [w.strip(EDGE) for w in words[max(0, i - reach) : i + reach + 1]]
            inside = marks is not None and (marks[i - 1] if i else 0) % 2 == 1
            told = inside or (marks is not None and any(q in words[i] for q in QUOTES)) or any(w in REPORTING for w in around[:reach])
            spoken = any(w in ADDRESS for w in around)
            near += kind in (2, 4)
            stems += kind == 3
            quoted += told
            addressed += spoken
            score += (0.25 if told else 1.0) * (1.5 if spoken else 1.0) * WEIGHT.get(kind, 1.0)
        dense = int((np.searchsorted(at, at + 50) - np.arange(len(at))).max())
        return (float(len(hits)), near, stems, score, float(dense), quoted / len(hits), addressed / len(hits), math.log1p(n), 100 * len(hits) / n)


def term_counter(among: frozenset | None):
    """Per task: in how many documents a word, or a stem of one, stands; of ``among`` if given."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = {w.strip(EDGE) for w in text.lower().split()}
                words = {w for w in words if len(w) >= 4 and w.isalpha()}
                found = {(w, 0) for w in words} | {(w[:k], k) for w in words for k in (4, 5, 6) if len(w) > k}
                seen.update(found if among is None else found & among)
        keys = list(seen)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            columns = [pa.array([t for t, _ in part]), pa.array([k for _, k in part], pa.int32()), pa.array([seen[x] for x in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "stem", "n"])

    return run


def term_counts(rows: DataFrame, among: frozenset | None = None) -> DataFrame:
    counted = rows.select("text").mapInArrow(term_counter(among), "term string, stem int, n long")
    return counted.groupBy("term", "stem").agg(F.sum("n").alias("n"))


def learned_terms(sample: DataFrame, least: int = 4, share: float = 0.04) -> tuple[list[str], list[str]]:
    """Words and stems that stand in at least ``share`` of the label-1 rows and nearly nowhere else.

    All of them: a row of the (bounded) sample has its words, so there are no more terms with
    that share than a row has words on average, divided by the share.
    The share keeps out words that only a group of copies has. A stem stands for the
    words that begin with it where none of them alone is nearly as frequent.
    """
    bounded_batches(sample.sparkSession)
    total = sample.filter("label > 0").count()
    floor = max(least, math.ceil(share * total))
    toxic = term_counts(sample.filter("label > 0")).filter(F.col("n") >= floor)
    found = {(r.term, r.stem): r.n for r in toxic.collect()}
    clean = {(r.term, r.stem): r.n for r in term_counts(sample.filter("label = 0"), frozenset(found)).collect()}
    found = {k: n for k, n in found.items() if n >= 19 * clean.get(k, 0)}
    words = {t: n for (t, k), n in found.items() if k == 0}
    stems: list[str] = []
    for (term, k), n in sorted(found.items(), key=lambda x: (x[0][1], x[0][0])):
        if k and not any(term.startswith(s) for s in stems):
            if max((m for w, m in words.items() if w.startswith(term)), default=0) < 0.8 * n:
                longer = [(j, t) for (t, j), m in found.items() if j > k and t.startswith(term) and m >= 0.95 * n]
                stems.append(max(longer)[1] if longer else term)
    return sorted(w for w in words if not any(w.startswith(s) for s in stems)), stems


def extractor(terms: list[str], stems: list[str]):
    def run(batches):
        lexicon = Lexicon(terms, stems, least=LEAST)
        for batch in batches:
            rows = lexicon.all_features([t or "" for t in batch.column("text").to_pylist()])
            columns = list(zip(*rows)) if rows else [()] * len(FEATURES)
            names = [n for n in batch.schema.names if n != "text"]
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.float64()) for c in columns)], [*names, *FEATURES])

    return run


def hit_features(rows: DataFrame, terms: list[str], stems: list[str]) -> DataFrame:
    bounded_batches(rows.sparkSession)
    kept = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(extractor(terms, stems), f"{kept}, " + ", ".join(f"{c} double" for c in FEATURES))


def scorer(model: gam.Additive):
    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64()), batch.column("hits")], ["doc_id", "score", "hits"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, max_labelled: int) -> tuple[list[str], list[str], gam.Additive]:
    """Terms, stems and the model, from the labelled sample."""
    sample = materialize(labelled(docs, labels, label, mod, remainder, max_labelled), "toxicity")
    words, stems = learned_terms(sample)
    terms = sorted({*TERMS, *words})
    rows = hit_features(sample, terms, stems).toPandas().sort_values(["doc_id", *FEATURES])
    discard(sample)
    return terms, stems, gam.fit(rows[FEATURES].to_numpy(dtype=float), (rows["label"].to_numpy() > 0).astype(float), n_pairs=2, rounds=80)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, remainder: int = 0, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits for every row of ``docs``."""
    terms, stems, model = train(docs, labels, label, mod, remainder, max_labelled)
    scored = hit_features(texts(docs), terms, stems).mapInArrow(scorer(model), "doc_id long, score double, hits double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), mod, remainder).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("hits").cast("long").alias("n_hits"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, remainder: int = 0, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose ``text`` is not predicted to be toxic. No row is moved."""
    terms, stems, model = train(docs, labels, label, mod, remainder, max_labelled)
    bounded_batches(docs.sparkSession)
    where = docs.columns.index("text")

    def run(batches):
        lexicon = Lexicon(terms, stems, least=LEAST)
        for batch in batches:
            found = lexicon.all_features([t or "" for t in batch.column(where).to_pylist()])
            x = np.array(found, dtype=float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) < 0.5, pa.bool_()))
        tidy()

    return docs.mapInArrow(run, docs.schema)

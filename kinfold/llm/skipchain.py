"""Personal data: fixed patterns, and a skip-chain conditional random field over a document.

The fixed patterns give the base spans. The field's nodes are those spans (their labels
are given), what the patterns found and refused, other tokens with an at sign or seven
digits, and the name before an address's at sign wherever it stands again (of six signs or
more, with a dot, underscore or digit: plainer names are words as well). Neighbouring nodes
share a chain potential; nodes with the same normal form, name or last nine digits share a
skip potential wherever in the document they stand, and loopy belief propagation passes
messages until the labels of the document agree. A node that comes out as personal data
with a probability of ``sure`` adds a span; base spans always stay.

The weights of nodes, chains and skips are learned together by pseudo-likelihood: each
node's label given its shape and the labels of its neighbours, over at most ``max_sampled``
documents. The labels are the patterns' own; names have none and are left out of it. Each
kind of row counts as often as it stands in the sample. Every document is searched, over
its whole text, in time linear in it: a node is linked to the last one of each of its keys.

Defined results: null and empty texts have no spans; repeated rows are treated alike; an
empty table gives no rows; other columns are ignored, and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import bounded_batches, texts

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
MAX_SAMPLED = 2000
REACH = 200  # characters between chained nodes
LINKS = (0.2, 4.0)  # chain and skip weight that the ridge pulls to: without data neighbours say little, equal forms much
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@+]")
TOKEN = re.compile(r"\S+")
HINT = re.compile(r"[0-9@]")
NAME = re.compile(r"[A-Za-z0-9._%+-]+")
EDGE = ".,;:!?\"'()[]{}<>|*&$#="
NOT_DIGIT = re.compile(r"[^0-9]")
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign outwards in time linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Accepted and refused matches of the fixed patterns."""
    kept: list[Span] = []
    refused: list[Span] = []
    if not SIGN.search(text):
        return kept, refused
    kept += [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        good = all(len(p) < 4 and int(p or 0) <= 255 for p in parts)
        (kept if good else refused).append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        good = 14 <= len(digits) <= 19 and luhn(digits)
        if good or len(digits) >= 7:
            (kept if good else refused).append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = len(NOT_DIGIT.sub("", m.group()))
            (kept if 10 <= n <= 15 else refused).append((m.start(), 3, m.end()))
    return sorted(kept), sorted(refused)


@dataclass
class Node:
    start: int
    end: int
    label: int | None  # of a base span
    form: str
    shape: np.ndarray


SHAPES = "digits7 digits10 digits14 digits20 luhn plus at domain dots3 octets spaced hyphen brackets letters hex named bias".split()
NAMED = SHAPES.index("named")  # names stand without a label: their own shape says nothing, their links decide


def shape(piece: str) -> np.ndarray:
    digits = NOT_DIGIT.sub("", piece)
    n = len(digits)
    parts = piece.split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    letters = sum(c.isalpha() for c in piece)
    at = piece.find("@")
    return np.array(
        [
            7 <= n < 10,
            10 <= n < 14,
            14 <= n < 20,
            n >= 20,
            14 <= n < 20 and luhn(digits),
            piece.startswith("+"),
            at > 0,
            at > 0 and "." in piece[at:],
            piece.count(".") == 3,
            octets,
            " " in piece,
            "-" in piece,
            "(" in piece,
            letters > 0,
            n > 0 and letters > 0 and at < 0,
            at < 0 and n < 7,
            not (at < 0 and n < 7),
        ],
        dtype=float,
    )


def normal(piece: str) -> str:
    digits = NOT_DIGIT.sub("", piece)
    return digits if len(digits) >= 7 and not any(c.isalpha() for c in piece) else piece.strip(EDGE).lower()


class Cover:
    """What a set of intervals covers, as disjoint runs."""

    def __init__(self, spans):
        self.begins: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.begins.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.begins, b)
        return k == 0 or self.ends[k - 1] <= a


def local_part(form: str) -> str:
    return form.split("@")[0].lower()


def nodes(text: str) -> list[Node]:
    """Of a document with something to decide; none where the base spans are all there is to see."""
    kept, refused = base_spans(text)
    taken = Cover((a, b) for a, _, b in kept)
    extra = {(a, b): None for a, _, b in refused if taken.free(a, b)}
    if SIGN.search(text):
        around = Cover([*((a, b) for a, _, b in kept), *extra])
        for m in TOKEN.finditer(text):
            piece = m.group()
            if HINT.search(piece) is None:
                continue
            bare = piece.strip(EDGE)
            a = m.start() + piece.find(bare)
            if bare and ("@" in bare or len(NOT_DIGIT.sub("", bare)) >= 7) and around.free(a, a + len(bare)):
                extra[(a, a + len(bare))] = None
    names = {local_part(text[a:b]) for a, k, b in kept if k == 0}
    names = {n for n in names if len(n) >= 6 and any(c in "._0123456789" for c in n)}
    if names:
        for m in NAME.finditer(text):
            a, b = m.start(), m.start() + len(m.group().rstrip("."))
            after = text[m.end() : m.end() + 1]
            if text[a:b].lower() in names and after != "@" and not after.isalnum() and not text[a - 1 : a].isalnum() and taken.free(a, b):
                extra[(a, b)] = None
    found = [Node(a, b, k, normal(text[a:b]), shape(text[a:b])) for a, k, b in kept]
    found += [Node(a, b, None, normal(text[a:b]), shape(text[a:b])) for a, b in extra]
    return sorted(found, key=lambda x: (x.start, x.end))


def skips(found: list[Node]) -> list[tuple[int, int]]:
    """Links from each node to the last before it with the same form, name or nine last digits."""
    last: dict[tuple[str, str], int] = {}
    links = set()
    for i, node in enumerate(found):
        keys = [("form", node.form), ("name", local_part(node.form))]
        if node.form.isdigit() and len(node.form) >= 9:
            keys.append(("digits", node.form[-9:]))
        for key in keys:
            if key in last:
                links.add((last[key], i))
            last[key] = i
    return sorted(links)


def chains(found: list[Node], reach: int) -> list[tuple[int, int]]:
    """Neighbours with no more than ``reach`` characters between them."""
    return [(i, i + 1) for i in range(len(found) - 1) if found[i + 1].start - found[i].end <= reach]


@dataclass
class Field:
    weights: np.ndarray  # shapes x labels
    chain: float
    skip: float
    reach: int = REACH

    def marginals(self, found: list[Node], rounds: int = 12, damping: float = 0.3) -> np.ndarray:
        """Label probabilities of each node by damped sum-product message passing."""
        n, labels = len(found), OTHER + 1
        own = np.array([x.shape for x in found]) @ self.weights
        for i, x in enumerate(found):
            if x.label is not None:
                own[i] = -30.0
                own[i, x.label] = 0.0
        pairs = [(i, j, self.chain) for i, j in chains(found, self.reach)] + [(i, j, self.skip) for i, j in skips(found)]
        own -= own.max(axis=1, keepdims=True)
        if not pairs:
            p = np.exp(own)
            return p / p.sum(axis=1, keepdims=True)
        a = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
        b = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
        gain = np.exp(np.array([p[2] for p in pairs] * 2)) - 1
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.full((len(a), labels), 1.0 / labels)
        for _ in range(rounds):
            logs = np.log(message)
            belief = own.copy()
            np.add.at(belief, b, logs)
            out = belief[a] - logs[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out = out.sum(axis=1, keepdims=True) + gain[:, None] * out  # a potential of exp(weight) where labels agree
            out /= out.sum(axis=1, keepdims=True)
            step = (1 - damping) * out + damping * message
            if np.abs(step - message).max() < 1e-6:
                message = step
                break
            message = step
        belief = own.copy()
        np.add.at(belief, b, np.log(message))
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str, sure: float = 0.9) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        base, refused = base_spans(text)
        if not base and not refused and not SIGN.search(text):
            return base, base
        found = nodes(text)
        if all(x.label is not None for x in found):
            return base, base
        p = self.marginals(found)
        added = [(x.start, int(np.argmax(row)), x.end) for x, row in zip(found, p) if x.label is None and row.argmax() != OTHER and row.max() >= sure]
        return base, sorted({*base, *added})


def fit(rows: list[tuple[list[float], list[float], list[float], int, int]], steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """The weights of the largest pseudo-likelihood, from (shape, chained labels, skipped labels, label, count)."""
    weights = np.zeros((len(SHAPES), OTHER + 1))
    weights[-1, OTHER] = 2.0  # without data nothing is added
    links = np.array(LINKS)
    if rows:
        x, near = np.array([r[0] for r in rows], dtype=float), np.array([[r[1], r[2]] for r in rows], dtype=float)
        y, n = np.eye(OTHER + 1)[[r[3] for r in rows]], np.array([r[4] for r in rows], dtype=float)
        n /= n.sum()
        for _ in range(steps):
            z = x @ weights + np.tensordot(near, links, axes=(1, 0))
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            miss = (y - p) * n[:, None]
            weights += rate * (x.T @ miss - ridge * weights)
            links = links + rate * (np.einsum("rly,ry->l", near, miss) - ridge * (links - LINKS))
    return Field(weights, *np.maximum(links, 0.0).tolist())


def _training(batches):
    names = ["shape", "chain", "skip", "label"]
    kinds = [*[pa.list_(pa.float64())] * 3, pa.int32()]
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            found = nodes(text)
            seen = [None if x.shape[NAMED] and x.label is None else OTHER if x.label is None else x.label for x in found]
            near = np.zeros((2, len(found), OTHER + 1))
            for k, pairs in enumerate((chains(found, REACH), skips(found))):
                for i, j in pairs:
                    if seen[i] is not None and seen[j] is not None:
                        near[k, i, seen[j]] += 1
                        near[k, j, seen[i]] += 1
            rows += [(x.shape.tolist(), near[0, i].tolist(), near[1, i].tolist(), seen[i]) for i, x in enumerate(found) if seen[i] is not None]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def train(docs: DataFrame, max_sampled: int = MAX_SAMPLED) -> Field:
    """The field learned from the first ``max_sampled`` documents with signs, in order of a hash.

    Equal rows are counted before they come to the driver: there are no more different ones
    than shapes and neighbours' labels, as a node has two chained and few skipped neighbours.
    """
    bounded_batches(docs.sparkSession)
    rows = texts(docs).filter("text rlike '[0-9@]'")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    picked = rows.select("doc_id").distinct().orderBy(order, "doc_id").limit(max_sampled)
    sample = rows.join(F.broadcast(picked), "doc_id").select("text")
    kinds = ["shape", "chain", "skip", "label"]
    counted = sample.mapInArrow(_training, "shape array<double>, chain array<double>, skip array<double>, label int").groupBy(*kinds).count()
    found = sorted((r.shape, r.chain, r.skip, r.label, r["count"]) for r in counted.collect())
    return fit(found)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def finder(field: Field):
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"]
    kinds = [*[pa.int64()] * len(KINDS), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = field.spans(text)
                counts = [sum(k == j for _, k, _ in base) for j in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base), len(spans)))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return run


def personal_data(docs: DataFrame, max_sampled: int = MAX_SAMPLED) -> DataFrame:
    """doc_id, base counts, base_sha256, all spans, the number added and of all, for every row of ``docs``."""
    field = train(docs, max_sampled)
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long"
    return texts(docs).mapInArrow(finder(field), schema)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each span, overlaps merged, replaced by its kind in brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redactor(field: Field, names: list[str], text_col: str):
    def run(batches):
        for batch in batches:
            found = [None if t is None else redacted(t, field.spans(t)[1]) for t in batch.column(text_col).to_pylist()]
            yield batch.set_column(names.index(text_col), text_col, pa.array(found, pa.string()))

    return run


def redact(docs: DataFrame, max_sampled: int = MAX_SAMPLED) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; all other columns as they are."""
    field = train(docs, max_sampled)
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(redactor(field, docs.columns, "text"), docs.schema)

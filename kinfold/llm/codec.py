"""Encoding as the tokenizers library does, with each distinct piece encoded once a worker.

A tokenizer file is read on the driver and its content goes with the tasks, so executors
need no file of their own. A text is cut into units where the file's pre-tokenizer cuts
whatever stands around: before a space that a sign follows (byte-level files) or at white
space (files that drop it). Units of printable ASCII and precomposed Latin letters are
split further by the file's own pattern. Pieces are encoded independently of each other,
so the library encodes those that are not remembered, those of many texts in one call, and
the ids are the library's, in any script. Texts with a special token's opening, and texts
for files of another kind, go to the library whole. What a worker remembers is two
generations of ``memo_pieces`` pieces at most.
"""

from __future__ import annotations

import json
import os
import re
from array import array

MEMO_PIECES = 150_000  # of about 170 bytes each
BATCH_SIGNS = 2 << 20  # texts whose new pieces are learned in one go

#: A byte-level unit begins with a space that another sign follows; other units stand between white space.
SPACED = re.compile(r" (?=\S)")
BLANK = re.compile(r"[ \t\n\r]+")

# The classes and patterns that the two kinds of tokenizer file split by.
SAFE = re.compile("[\t\n\r -~¡-įı-ſ]*")
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼-¾"
BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
WORD_END = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")

_CODECS: dict[int, "Codec"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_tokenizer(path: str) -> str:
    """A tokenizer file's content without truncation and padding."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return json.dumps(spec | {"truncation": None, "padding": None}, ensure_ascii=False)


def codec(spec: str) -> "Codec":
    """This worker's codec of a tokenizer file, with what it remembers."""
    key = hash(spec)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def kind_of(spec: dict) -> str | None:
    """``spaced`` or ``blank``, by where the pre-tokenizer of a file always cuts; None if that is not known."""
    if spec.get("model", {}).get("dropout") is not None:
        return None
    split = json.dumps(spec.get("pre_tokenizer"))
    if spec.get("normalizer") is None and '"type": "ByteLevel", "add_prefix_space": false' in split and '"use_regex": true' in split and "Sequence" not in split:
        return "spaced"
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and '"invert": true' in split and r"[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in split:
        return "blank"
    return None


class Memo:
    """Ids of the pieces met lately. A full generation becomes the old one, from which what is met again moves over."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def hold(self, pieces: set[str], make) -> None:
        """Have ``young`` hold all of ``pieces``; ``make`` gives the ids of those that are new."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        pieces = pieces.difference(self.young)
        if self.old:
            back = pieces.intersection(self.old)
            self.young.update(zip(back, map(self.old.__getitem__, back)))
            pieces = pieces.difference(back)
        new = list(pieces)
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            self.young.update(zip(part, make(part)))


class Codec:
    def __init__(self, spec: str, memo_pieces: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        self.kind = kind_of(parsed)
        self.added = [t["content"] for t in parsed.get("added_tokens", [])]
        self.openings = sorted({t[:2] for t in self.added})
        self.memo = Memo(memo_pieces)
        self._table: list[bytes] | None = None
        self._shown = list(map(str, range(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1))))

    def divides(self, text: str) -> bool:
        """Whether parts of ``text`` between boundaries may be encoded by themselves."""
        return self.kind is not None and not any(o in text for o in self.openings)

    def pieces(self, text: str) -> list[str]:
        """Parts of ``text``, which starts at a boundary, that the library encodes independently of each other."""
        if self.kind == "spaced":
            if SAFE.fullmatch(text):
                return BYTE_LEVEL.findall(text)
            units = SPACED.split(text)
            units = [units[0], *(" " + u for u in units[1:])]
            return [p for u in units if u for p in (BYTE_LEVEL.findall(u) if SAFE.fullmatch(u) else (u,))]
        if SAFE.fullmatch(text):
            return WORD_END.findall(text.lower())
        return [p for u in BLANK.split(text) if u for p in (WORD_END.findall(u.lower()) if SAFE.fullmatch(u) else (u,))]

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, signs = at, 0
            while end < len(texts) and (end == at or signs < BATCH_SIGNS):
                signs += len(texts[end])
                end += 1
            parts = [self.pieces(t) if self.divides(t) else None for t in texts[at:end]]
            self.memo.hold(set().union(*(p for p in parts if p is not None)), self.by_library)
            look = self.memo.young.__getitem__
            out += [self.whole(t) if p is None else b"".join(map(look, p)) for t, p in zip(texts[at:end], parts)]
            at = end
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def table(self) -> list[bytes]:
        """The bytes that each id stands for, in a byte-level vocabulary."""
        if self._table is None:
            alphabet = byte_alphabet()
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self._table = [b""] * (1 + max(vocabulary.values(), default=-1))
            added = set(self.added)
            for token, i in vocabulary.items():
                plain = token not in added and all(c in alphabet for c in token)
                self._table[i] = bytes(alphabet[c] for c in token) if plain else token.encode()
        return self._table

    def shown(self) -> list[str]:
        """The decimal string of each id."""
        return self._shown

    def decode(self, ids: list[int]) -> str:
        """As the library decodes byte-level ids with special tokens kept."""
        return b"".join(map(self.table().__getitem__, ids)).decode("utf-8", "replace")

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinfold.llm import bitplanes, chunkreuse, codec
from tests.llm import cases

ODD = ["", " ", "  a  b\n\n c", "don't we'll 'S", "a<|endoftext|>b", "x ý 中文 İstanbul ΣΑΣ", "1²3 ½ 12345 --- ##!!\n\n\n", "\t\ttabs  \r\n x", "ŸſÀé ŉ ª º"]


def mixed(n=120):
    rng = random.Random(2)
    signs = ["a", "B", " ", "  ", "\n", "'s", "'", "1", "é", ".", "-"]
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 3000))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_codec_is_the_library(name):
    path = public_tokenizers.path(name)
    tool, library = codec.Codec(codec.read_tokenizer(path)), Tokenizer.from_file(path)
    for text in mixed():
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tool.encode(text), "<u4").tolist() == want
        if name[0] == "b":
            assert tool.decode(want) == library.decode(want, skip_special_tokens=False)


def pool(tool, texts, mask):
    """Ids of all chunks of ``texts``, each encoded once, where it first stands."""
    found = {}
    for text in texts:
        for digest, first, last in chunkreuse.chunks(tool, text, mask):
            found.setdefault(digest, chunkreuse.narrow(tool, tool.encode(text[first:last])))
    return found


def by_chunks(tool, texts, mask):
    ids = pool(tool, texts, mask)
    return chunkreuse.encode_with(tool, [(t, [(a, b, ids[d]) for d, a, b in chunkreuse.chunks(tool, t, mask)]) for t in texts])


@pytest.mark.parametrize("mask", [2, 4, 7])
def test_chunk_joins(mask):
    tool = codec.Codec(codec.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    texts = [*mixed(), cases.prose(random.Random(4), 2000)]
    assert by_chunks(tool, texts, mask) == [tool.whole(t) for t in texts]
    assert len(pool(tool, texts, mask)) > 10


def test_joins_at_contractions(monkeypatch):
    tool = codec.Codec(codec.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    wrong = []
    for text in ("so they're here", "we've 'll 're ''ve x'llama", "I'll  say they'r and 'v 'l're", "a b c d e f g they're h", "1'l'll'v've'r're", "a  b \n c   d\u00a0 e "):
        for a in range(1, len(text)):
            for b in range(a, len(text)):
                monkeypatch.setattr(chunkreuse, "cuts", lambda t, mask: sorted({a, b, len(t)}))
                if by_chunks(tool, [text], 1) != [tool.whole(text)]:
                    wrong.append((text, a, b))
    assert not wrong


def test_chunks_of_any_script():
    tool = codec.Codec(codec.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(7)
    signs = ["a", "they're", " ", "  ", "\n", "'", "1", "é", ".", "“", "–", "\u00a0", "\u2003", "я", "文", "🙂", "e\u0301", "\x85", "\x1c", "\x0b", "\u3000", "²"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    assert by_chunks(tool, texts, 2) == [tool.whole(t) for t in texts]
    blank = codec.Codec(codec.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    assert blank.encode_all(texts) == [blank.whole(t) for t in texts]
    prose = " ".join(rng.choice(["слово", "λόγος", "“quoted”", "word"]) + str(k % 7) for k in range(3000))
    assert len(pool(tool, [prose], 5)) > 10


def test_small_memo_gives_the_same():
    spec = codec.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    small, large = codec.Codec(spec, 1), codec.Codec(spec)
    for text in mixed(20):
        assert small.encode(text) == large.encode(text)


def test_equal_passages_share_chunks():
    passage = cases.prose(random.Random(1), 800)
    parts = []
    for before in ("one two ", "three "):
        text = before + passage
        ends = chunkreuse.cuts(text, mask=6)
        parts.append({text[a:b] for a, b in zip(ends, ends[1:])})
    assert len(parts[0] & parts[1]) > 10


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_planes_round_trip(planes):
    rng = np.random.default_rng(0)
    for ids in (np.zeros(1), rng.integers(0, 50_000, 777), rng.integers(0, 2**32, 65), np.zeros(64)):
        ids = ids.astype("<u4")
        assert (bitplanes.unpack(len(ids), bitplanes.pack(ids, planes), planes) == ids).all()


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_files(spark, planes, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs, library = cases.documents(spark), Tokenizer.from_file(path)
    bitplanes.write_planes(docs, str(tmp_path / "f"), path, planes=planes, block_ids=50, chunk_ids=120)
    got = sorted(map(tuple, bitplanes.read_documents(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc_id, text in sorted(cases.pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    index = bitplanes.chunk_index(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert index[0].start == 0 and index[-1].start + index[-1].n_ids == start
    assert bitplanes.round_trip(cases.empty(spark), path).count() == 0


def test_damage_is_seen():
    ids = np.arange(10, dtype="<u4")
    row = {"part": 0, "chunk": 0, "n_ids": 10, "checksum": 1, "planes": "byte", "blocks": [{"n": 10, "planes": bitplanes.pack(ids, "byte")}]}
    with pytest.raises(ValueError, match="damaged"):
        bitplanes.read_chunk(row)


def test_encode_decode(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs, library = cases.documents(spark), Tokenizer.from_file(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in cases.pairs(docs):
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    for mask in (chunkreuse.MASK, 4):
        assert sorted(map(tuple, chunkreuse.encode_decode(docs, path, mask).collect()), key=str) == sorted(want, key=str)
    assert chunkreuse.encode_decode(cases.empty(spark), path).count() == 0

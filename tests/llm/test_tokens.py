from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from citetrust.llm import bpe, packing, tokens
from citetrust.llm.work import utf8
from texts import frame, odd_rows

ODD = [
    "", None, "a", " ", "  x  ", "don't I'LL it'S", "<|endoftext|>hi<|startoftext|>", "x<|endoftext|>y  <|endo", "foo -",
    "é é ́e ａｂｃ", "  a b c\x1cd\x85e", "İstanbul ΣΑΣ Σ ß ẞ", "日本語 テキスト 한국어", "a" * 5000, "1234 5½ ²³", "- foo", "-",
    "__foo__ //bar 's 'S", "\u0301", "👍🏽👍", "</w> a</w>", "µ ª º ×÷", "x\u0300y", "\x00a\x00 \x1f", "ÀÉÞÿ÷×Ã", "Ã©",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary())


def random_texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    signs = ["aé '’<|>sS\n\t ́ßİ9%ÀÞ×", "ab-É9 \n", "abc"]
    return ["".join(rng.choice(signs[k % 3]) for _ in range(rng.randint(0, 700))) for k in range(150)]


def test_ids_and_decoding_are_the_librarys(library):
    texts = ODD + random_texts(1)
    store = bpe.ChunkStore(20_000)  # so small that chunks are dropped and met again
    of = tokens.encoder(tokens.vocabulary())
    for _ in range(2):
        for text, (ids, decoded) in zip(texts, bpe.encode_texts(pa.array(texts, pa.string()), of, store), strict=True):
            expected = library.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == expected, text
            assert decoded.decode() == library.decode(expected, skip_special_tokens=False)


def test_forgetting_units_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    of = tokens.Encoder(tokens.vocabulary())
    for text in random_texts(2)[:30]:
        ids, _ = of.encode(*utf8(pa.array([text])))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_follow_the_content():
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(4000))
    one, two = (bpe.cuts(*utf8(pa.array([p + passage])))[0] - len(p) for p in ("", "some other words before "))
    assert len(one) > 5 and set(one.tolist()) <= set(two.tolist()) and all(x < 16 for x in set(two.tolist()) - set(one.tolist()))


def test_encode_decode_rows(spark, library):
    rows = odd_rows()
    got = bpe.encode_decode(frame(spark, rows)).collect()
    expected = []
    for k, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((k, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    assert bpe.encode_decode(frame(spark, [])).count() == 0


def test_packing_places_each_piece_once(spark, library):
    rows = odd_rows()
    got = packing.pack_documents(frame(spark, rows), length=256).collect()
    pieces = defaultdict(list)
    for k, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for n, a in enumerate(range(0, len(ids), 256)):
            crc = zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())
            pieces[k].append((n, a, len(ids[a : a + 256]), crc))
    found, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in pieces.items()}
    total = 0
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
        total += at
    gaps = []  # first fit, longest first
    for size in sorted((p[2] for v in pieces.values() for p in v), reverse=True):
        fit = next((k for k, gap in enumerate(gaps) if gap >= size), None)
        if fit is None:
            gaps.append(256 - size)
        else:
            gaps[fit] -= size
    assert len(sequences) <= len(gaps)
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_best_two_replaces_the_smallest():
    # 60 leaves 40; greedily 30 goes in, but 25 and 15 fill the gap.
    assert packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0] == ([60, 25, 15], 1)
    assert packing.best_two_fit({}, 100) == []
    assert packing.best_two_fit({50: 5}, 100) == [([50, 50], 2), ([50], 1)]


def test_fillings_use_every_piece():
    rng = np.random.default_rng(5)
    sizes, counts = np.unique(np.minimum(rng.lognormal(4, 1, 5000).astype(int) + 1, 512), return_counts=True)
    counts = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
    used, fillings = defaultdict(int), packing.best_two_fit(counts, 512)
    for filling, times in fillings:
        assert sum(filling) <= 512
        for size in filling:
            used[size] += times
    assert used == counts
    assert sum(t for _, t in fillings) <= 1.01 * sum(s * n for s, n in counts.items()) / 512 + 1


def test_long_words_are_told_apart(library, spark):
    """Words whose polynomial hashes modulo 2^64 agree whatever the base is."""
    rows = []
    for k in range(8, 14):
        one = "".join("ab"[bin(n).count("1") % 2] for n in range(1 << k))
        rows += [(2 * k, one), (2 * k + 1, one.translate(str.maketrans("ab", "ba")))]
    ids = {k: np.array(library.encode(t, add_special_tokens=False).ids, "<u4") for k, t in rows}
    got = {r.doc_id: r.ids_sha256 for r in bpe.encode_decode(frame(spark, rows)).collect()}
    assert got == {k: hashlib.sha256(v.tobytes()).hexdigest() for k, v in ids.items()}
    of = tokens.Encoder(tokens.vocabulary())
    found, at = of.encode(*utf8(pa.array([t for _, t in rows])))
    for (k, _), a, b in zip(rows, at[:-1], at[1:], strict=True):
        assert found[a:b].tolist() == ids[k].tolist()
    for r in packing.pack_documents(frame(spark, rows)).collect():
        whole = np.append(ids[r.doc_id], 1).astype("<u4")
        assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())

"""Token ids of the word-end BPE vocabulary, exactly as its tokenizer gives them, for many texts at once.

The tokenizer never joins or compares text across ASCII white space: its normalization, its word pattern and its
special tokens all stay within a run of other characters. Its word pattern cuts a run of printable ASCII and Latin
letters, without apostrophe or ``<``, into letters, single digits, and other characters; case is dropped. So a text
is a row of units, such words or else whole runs. Numpy finds the units of many texts, each distinct one is
encoded by the tokenizer once in a worker, and the ids are put together by index.
"""

from __future__ import annotations

import os

import numpy as np

from citetrust.llm.words import LOWER, Rolling, SPACE, mix

KEPT = 600_000  # units kept by a worker
JOINED = 2_000  # words in one call of the tokenizer

# Classes of bytes: 0 white space, 1 letter, 2 digit, 3 other. Bytes from 0x80 on are letters in plain runs.
CLASS = np.full(256, 3, np.uint8)
CLASS[SPACE] = 0
CLASS[ord("a") : ord("z") + 1] = CLASS[ord("A") : ord("Z") + 1] = 1
CLASS[0x80:] = 1
CLASS[ord("0") : ord("9") + 1] = 2
# Bytes with which a run is encoded as a whole. The lead byte of Latin letters (0xC3) and what may follow it are not.
ODD_BYTE = np.zeros(256, bool)
ODD_BYTE[:0x21] = True
ODD_BYTE[0x7F:] = True
ODD_BYTE[[ord("'"), ord("<")]] = True
ODD_BYTE[SPACE] = False
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False  # multiplication and division signs
UPPER_LATIN = np.zeros(256, bool)
UPPER_LATIN[0x80:0x9F] = True
UPPER_LATIN[0x97] = False


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with plain runs in lower case, start, end and oddness of each unit)."""
    n = len(data)
    kind = CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    lead = data == 0xC3
    after = np.zeros(n, bool)
    after[1:] = lead[:-1]
    after &= LATIN[data] & ~edge[:-1]
    odd = ODD_BYTE[data] & ~after
    odd[:-1] &= ~(lead[:-1] & after[1:])
    solid = kind > 0
    begins = edge[:-1].copy()
    begins[1:] |= ~solid[:-1]
    begins &= solid
    run = np.cumsum(begins) - 1  # of each byte; only looked at where solid
    odd_run = np.zeros(int(run[-1]) + 1 if n else 0, bool)
    odd_run[run[odd & solid]] = True
    whole = np.zeros(n, bool)
    if odd_run.any():
        whole[solid] = odd_run[run[solid]]
    starts = begins.copy()
    starts[1:] |= solid[1:] & ~whole[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    start = np.flatnonzero(starts)
    stop = starts.copy()
    stop |= ~solid | edge[:-1]
    stops = np.append(np.flatnonzero(stop), n)
    end = stops[np.searchsorted(stops, start, side="right")]
    low = LOWER[data]
    low[after & UPPER_LATIN[data]] += 0x20
    return np.where(whole, data, low), start, end, whole[start]


class Encoder:
    """A vocabulary file's tokenizer, and the units that a worker has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.words = Tokenizer.from_file(path)  # for words in lower case that are already cut
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        size = max(self.whole.get_vocab(with_added_tokens=True).values()) + 1
        names = [self.whole.id_to_token(k) or "" for k in range(size)]
        self.names = [n.encode() for n in names]
        self.ends = np.array([n.endswith("</w>") for n in names])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _add(self, hashes: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.known), len(hashes)
        while k + n > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.size[k : k + n] = sizes
        self.begin[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(hashes, range(k, k + n), strict=True))

    def _learn(self, hashes: list[int], texts: list[bytes], odd: list[bool]) -> None:
        one_by_one = [k for k, x in enumerate(odd) if x]
        plain = [k for k, x in enumerate(odd) if not x]
        for first in range(0, len(plain), JOINED):
            part = plain[first : first + JOINED]
            joined = b" ".join([texts[k] for k in part]).decode()
            ids = np.array(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1  # each word's last token has the end mark
            if len(ends) == len(part):
                self._add([hashes[k] for k in part], ids, np.diff(ends, prepend=0))
            else:
                one_by_one += part
        for first in range(0, len(one_by_one), JOINED):
            part = one_by_one[first : first + JOINED]
            coded = self.whole.encode_batch_fast(
                [texts[k].decode("utf-8", "replace") for k in part], add_special_tokens=False
            )
            got = [x.ids for x in coded]
            self._add(
                [hashes[k] for k in part], np.array([i for x in got for i in x], np.uint32), np.array(list(map(len, got)))
            )

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts ``data[at[k]:at[k + 1]]``, and where each text's begin."""
        low, start, end, odd = units(data, at)
        hashes = Rolling(low).unlike(low, start, end)
        hashes[odd] = mix(hashes[odd])
        distinct, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        missing = [k for k, h in enumerate(keys) if h not in self.known]
        if len(self.known) + len(missing) > KEPT:
            self._forget()
            missing = list(range(len(keys)))
        if missing:
            raw = low.tobytes()
            place = first[missing]
            self._learn(
                [keys[k] for k in missing],
                [raw[a:b] for a, b in zip(start[place].tolist(), end[place].tolist(), strict=True)],
                odd[place].tolist(),
            )
        entry = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[unit]
        size = self.size[entry]
        to = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=to[1:])
        ids = self.flat[np.repeat(self.begin[entry] - to[:-1], size) + np.arange(to[-1])]
        return ids, to[np.searchsorted(start, at)]

    def decoded(self, ids: np.ndarray) -> bytes:
        """What the tokenizer's decode() returns for these ids with all special tokens kept."""
        names = self.names
        return b" ".join([names[k] for k in ids.tolist()])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

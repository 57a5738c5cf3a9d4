"""BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citetrust.llm.tokens import Encoder, encoder, vocabulary
from citetrust.llm.words import SPACE, Rolling
from citetrust.llm.work import by_slices, utf8

WINDOW = 16  # bytes of the rolling hash
MEAN_CHUNK = 256  # bytes
STORE_BYTES = 48 << 20  # of encoded chunks in a worker
UNBROKEN = b" "  # no run holds a space


class ChunkStore:
    """Chunks that were encoded in this worker, by digest; the oldest half goes when the store is full."""

    def __init__(self, limit: int = STORE_BYTES):
        self.limit, self.size = limit, 0
        self.kept: dict[bytes, tuple] = {}

    def put(self, key: bytes, value: tuple) -> None:
        self.size += 250 + sum(map(len, value))
        if self.size > self.limit:
            for old in list(self.kept)[: len(self.kept) // 2 + 1]:
                self.size -= 250 + sum(map(len, self.kept.pop(old)))
        self.kept[key] = value


def cuts(data: np.ndarray, at: np.ndarray, window: int = WINDOW, mean: int = MEAN_CHUNK) -> list[np.ndarray]:
    """Inner cut places of each text: after each window of bytes whose hash falls into one of ``mean`` classes.

    The places depend on the bytes around them only, so equal passages are cut alike in all documents.
    """
    hashes = Rolling(data).fixed(window)
    place = np.flatnonzero(hashes % np.uint64(mean) == 0) + window
    first = np.searchsorted(place, at[:-1] + window)
    last = np.searchsorted(place, at[1:])
    return [place[a:b] for a, b in zip(first, last, strict=True)]


def ends(chunk: bytes) -> tuple[bytes, bytes, bytes]:
    """(head, inside, tail): the runs that reach the two ends of a chunk, and what lies between.

    Tokens of the inside don't change whatever stands beside the chunk. A chunk of one unbroken run is all head, and
    its tail is UNBROKEN.
    """
    head = tail = b""
    inside = chunk
    if not SPACE[inside[0]]:
        head = inside.split(None, 1)[0]
        inside = inside[len(head) :]
        if not inside:
            return head, b"", UNBROKEN
    if inside and not SPACE[inside[-1]]:
        tail = inside.rsplit(None, 1)[-1]
        inside = inside[: -len(tail)]
    return head, inside, tail


def encode_all(texts: list[bytes], of: Encoder) -> list[tuple[bytes, bytes]]:
    """Ids (as bytes) and decoded text of each text."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    ids, to = of.encode(np.frombuffer(b"".join(texts), np.uint8), at)
    ids = ids.astype("<u4")
    pairs = zip(to[:-1].tolist(), to[1:].tolist(), strict=True)
    return [(ids[a:b].tobytes(), of.decoded(ids[a:b])) for a, b in pairs]


def encode_texts(column: pa.Array, of: Encoder, store: ChunkStore) -> list[tuple[bytes, bytes]]:
    """Ids and decoded text of each row. Chunks come from the store; what stands across a join is encoded again."""
    data, at = utf8(column)
    raw = data.tobytes()
    chunked: list[list[bytes]] = []
    fresh: dict[bytes, tuple] = {}
    got: dict[bytes, tuple] = {}
    for begin, end, inner in zip(at[:-1].tolist(), at[1:].tolist(), cuts(data, at), strict=True):
        keys, edges = [], [begin, *inner.tolist(), end]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                chunk = raw[a:b]
                key = hashlib.blake2b(chunk, digest_size=16).digest()
                keys.append(key)
                if key in got or key in fresh:
                    continue
                if key in store.kept:
                    got[key] = store.kept[key]
                else:
                    fresh[key] = ends(chunk)
        chunked.append(keys)
    coded = encode_all([inside for _, inside, _ in fresh.values()], of)
    for (key, (head, _, tail)), (ids, text) in zip(fresh.items(), coded, strict=True):
        got[key] = head, ids, text, tail
        store.put(key, got[key])
    # Joins: the run that two chunks (or more, if a chunk has no white space) share is encoded as a whole.
    plans: list[list] = []
    joined: dict[bytes, tuple] = {}
    for keys in chunked:
        parts, run = [], b""
        for key in keys:
            head, ids, text, tail = got[key]
            run += head
            if tail == UNBROKEN:
                continue
            if run:
                joined[run] = ()
                parts.append(run)
            if ids:
                parts.append((ids, text))
            run = tail
        if run:
            joined[run] = ()
            parts.append(run)
        plans.append(parts)
    joined = dict(zip(joined, encode_all(list(joined), of), strict=True))
    out = []
    for parts in plans:
        whole = [joined[p] if isinstance(p, bytes) else p for p in parts]
        out.append((b"".join([ids for ids, _ in whole]), b" ".join([text for ids, text in whole if ids])))
    return out


_stores: dict[str, ChunkStore] = {}


def encode_decode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``documents`` (doc_id, text).

    A null or empty text has no tokens; a null doc_id stays null; repeated rows are returned as often as they come;
    other columns are not read. One scan, no shuffle: documents are cut by a rolling hash, a chunk that several
    documents of a worker share is encoded once (the store is bounded), and joins are repaired by encoding the run
    across each join again. Texts may be of any length.
    """
    path = path or vocabulary()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        coded = encode_texts(part.column(1), encoder(path), _stores.setdefault(path, ChunkStore()))
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array([len(ids) // 4 for ids, _ in coded], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in coded], pa.string()),
                pa.array([hashlib.sha256(text).hexdigest() for _, text in coded], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return documents.select("doc_id", "text").mapInArrow(by_slices("text", work, 2 << 20), schema)

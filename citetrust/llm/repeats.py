"""Removal of byte strings that an earlier document holds already.

Whether the 50 bytes from some place on start in an earlier document, too, is what the longest-previous-factor array
tells. No corpus fits one suffix array, and no more than 50 bytes matter, so suffixes meet by anchors: of the 24-byte
strings in each 50 bytes the one with the smallest hash, which is the same wherever these 50 bytes stand. Documents
send hashes of their anchors and of the bytes around them. Where an earlier document has the same surroundings, all
50-byte strings over that anchor are repeats; where only the anchor agrees, the bytes around it are fetched, their
suffixes are sorted, and the nearest smaller owners in suffix order give the longest previous factors.

At the edges of what very many documents share, the surroundings of an anchor differ in each of them. Such anchors
are counted beforehand; the 50-byte strings that they are the anchors of meet by their own hashes, one group each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetrust.llm.words import Rolling, mix
from citetrust.llm.work import by_slices, slices, small_batches, stored, utf8

LENGTH = 50  # bytes of a repeat
ANCHOR = 24  # bytes of an anchor
BUCKET_ENTRIES = 800_000  # anchors of a bucket, about
RANGES = 8  # parts of a bucket that are looked at one after the other
SUFFIX_BYTES = 1 << 20  # of surroundings that are sorted at once, about; an anchor with more of them is common
SORT_BYTES = 1 << 18  # of surroundings that are sorted at once if their anchors allow it: what stays in a core's cache
SAMPLE = 16  # texts are counted where their hash modulo this is 0
SLOT_BITS = 24  # common anchors are told to tasks as one of so many bits each: 2 MB at any size of the corpus
NO_ID = (1 << 63) - 1  # stands for a null doc_id: later than all others

SPANS = "id bigint, text_hash bigint, starts binary, ends binary"
KEYS = ["id", "text_hash"]
STARTS, ENDS = "_span_starts", "_span_ends"  # names that no column of documents has


def sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def anchors(
    data: np.ndarray, at: np.ndarray, roll: Rolling, length: int, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all texts, the hash at each place, and the least hash of the bytes from it on.

    A place is an anchor if its hash is the least (or one of the least) of some ``length`` bytes of its text.
    """
    hashes = roll.fixed(width)
    reach = length - width + 1
    if len(data) < length:
        return np.zeros(0, np.int64), hashes, np.zeros(0, np.uint64)
    least = sliding(np.minimum, hashes, reach)
    valid = np.zeros(len(data) + 1, np.int32)
    fits = np.diff(at) >= length
    np.add.at(valid, at[:-1][fits], 1)
    np.add.at(valid, at[1:][fits] - length + 1, -1)
    least[np.cumsum(valid[: len(least)]) == 0] = 0
    around = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    return np.flatnonzero(sliding(np.maximum, around, reach) == hashes), hashes, least


def pack48(x: np.ndarray) -> bytes:
    """The upper 48 bits of 64-bit numbers."""
    return (x >> np.uint64(32)).astype("<u4").tobytes() + (x >> np.uint64(16)).astype("<u2").tobytes()


def unpack48(raw: bytes, begin: int, end: int) -> np.ndarray:
    n = len(raw) // 6
    high, low = np.frombuffer(raw, "<u4", n)[begin:end], np.frombuffer(raw, "<u2", n, 4 * n)[begin:end]
    return high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64) << np.uint64(16)


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of one text, sorted and merged where they touch or overlap."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.append(True, starts[1:] > ends[:-1])
    return starts[first], ends[np.append(np.flatnonzero(first)[1:] - 1, len(ends) - 1)]


def bits_of(x: np.ndarray) -> int:
    """How many bits the largest of these numbers (none below 0) takes."""
    return int(x.max()).bit_length() if len(x) else 0


def packed_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order by ``keys`` (numbers from 0 on, the first key counts most).

    If the keys and a place fit 64 bits, numbers of both are sorted, which is much faster than to sort places by keys.
    """
    n = len(keys[0])
    widths = [bits_of(k) for k in keys]
    places = max(n - 1, 0).bit_length()
    if sum(widths) + places > 64:
        return np.lexsort(keys[::-1])
    packed = np.zeros(n, np.uint64)
    for key, width in zip(keys, widths, strict=True):
        packed = packed << np.uint64(width) | key.astype(np.uint64)
    packed = packed << np.uint64(places) | np.arange(n, dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << places) - 1)).astype(np.int64)


def hash_order(anchor: np.ndarray, around: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The order by (anchor, around, owner) of 64-bit hashes: by the anchors' upper bits, then what agrees in these."""
    if not len(anchor):
        return np.zeros(0, np.int64)
    above = anchor - anchor.min()
    drop = max(0, bits_of(above) + (len(anchor) - 1).bit_length() - 64)
    above >>= np.uint64(drop)
    order = packed_order(above)
    above = above[order]
    same = above[1:] == above[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    part = order[tied]
    order[tied] = part[np.lexsort([owner[part], around[part], anchor[part]])]
    return order


def distinct_keys(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of id and text hash, and the number of each row's pair among them."""
    order = np.lexsort([hashes, ids])
    one, two = ids[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return one[new], two[new], number


def chunks(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Numbers as binary values, of the numbers from each place in ``cut`` to the next."""
    raw = pa.py_buffer(np.ascontiguousarray(values, "<i8"))
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * 8).astype(np.int32)), raw])


def span_rows(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(owners, their starts, their ends): the spans of each owner in ``owner`` (numbers from 0 on), as ``runs`` merges them."""
    order = packed_order(owner, starts)
    owner, starts, ends = owner[order], starts[order], ends[order]
    # One owner's spans lie behind all of the owner before.
    shift = owner * (int(ends.max()) + 1 if len(ends) else 0)
    starts, ends = starts + shift, np.maximum.accumulate(ends + shift)
    first = np.ones(len(owner), bool)
    first[1:] = starts[1:] > ends[:-1]
    last = np.append(first[1:], np.ones(min(len(owner), 1), bool))
    starts, ends, owner = (starts - shift)[first], (ends - shift)[last], owner[first]
    cut = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
    return owner[cut[:-1]], chunks(starts, cut), chunks(ends, cut)


# Rows between the steps: a block of anchors (bucket >= 0), or spans of one text that are settled (bucket < 0).
BLOCK = (
    "bucket bigint, anchors binary, surroundings binary, text binary, place binary, lead binary, tail binary, "
    "ids binary, hashes binary"
)
FOUND = "id bigint, text_hash bigint, starts binary, ends binary, place bigint, anchor bigint, target bigint"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.split(", ")]
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _names(schema))


def _spans(ids: np.ndarray, hashes: np.ndarray, starts: pa.Array, ends: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), starts, ends], _names(SPANS))


def _found(spans: pa.RecordBatch) -> pa.RecordBatch:
    """Spans that are settled as rows of FOUND."""
    return pa.RecordBatch.from_arrays([*spans.columns, *[pa.nulls(spans.num_rows, pa.int64())] * 3], _names(FOUND))


def _asked(ids: np.ndarray, hashes: np.ndarray, *asked: np.ndarray) -> pa.RecordBatch:
    """(place, anchor, target) to compare as rows of FOUND."""
    none = [pa.nulls(len(ids), pa.binary())] * 2
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(hashes), *none, *[pa.array(x.astype(np.int64)) for x in asked]], _names(FOUND)
    )


class _Part:
    """Anchors of the texts of a part (id, text_hash, text); of equal texts, those of the earliest."""

    def __init__(self, part: pa.RecordBatch, length: int, width: int):
        self.ids, self.text_hash = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        data, self.at = utf8(part.column(2))
        self.roll = Rolling(data)
        place, self.hashes, self.least = anchors(data, self.at, self.roll, length, width)
        text = np.searchsorted(self.at, place, side="right") - 1
        order = np.lexsort([self.ids, self.text_hash])
        copy = np.zeros(len(self.ids), bool)
        copy[order[1:]] = self.text_hash[order[1:]] == self.text_hash[order[:-1]]
        keep = ~copy[text]
        self.place, self.text = place[keep], text[keep]
        self.before, self.behind = length - width, length

    def surroundings(self, place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, text, low, high, anchor, around) of anchors."""
        low, high = np.maximum(place - self.before, self.at[text]), np.minimum(place + self.behind, self.at[text + 1])
        anchor = mix(self.hashes[place])  # least hashes are small numbers; buckets need even ones
        around = mix(self.roll.of(low, high) + (place - low).astype(np.uint64) * np.uint64(1 << 32) + anchor)
        return place, text, low, high, anchor, around

    def strings(self, place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same of the strings of full length that these are the anchors of, once each, by their own hashes."""
        back = np.arange(self.before + 1)
        start = (place[:, None] - back).reshape(-1)
        text, value = np.repeat(text, len(back)), np.repeat(self.hashes[place], len(back))
        inside = np.flatnonzero((start >= self.at[text]) & (start + self.behind <= self.at[text + 1]))
        inside = inside[self.least[start[inside]] == value[inside]]
        start, once = np.unique(start[inside], return_index=True)
        text, value = text[inside[once]], mix(value[inside[once]])
        return start, text, start, start + self.behind, mix(self.roll.of(start, start + self.behind) + value), value

    def sorted(self, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """``found`` in order of (anchor, around, owner), and whether an earlier text of the part has the same."""
        owner, anchor, around = self.ids[found[1]], found[4], found[5]
        order = hash_order(anchor, around, owner)
        found, owner = tuple(x[order] for x in found), owner[order]
        anchor, around = found[4], found[5]
        same = np.append(np.zeros(min(len(order), 1), bool), (anchor[1:] == anchor[:-1]) & (around[1:] == around[:-1]))
        return *found, owner > owner[np.flatnonzero(~same)][np.cumsum(~same) - 1]


def _slots(hashes: np.ndarray) -> np.ndarray:
    """The bit that stands for an anchor, by its hash."""
    return (mix(hashes) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _counted(length: int, width: int):
    """(anchor, slot, n): how many rows a part would send of each anchor, from the same rows."""

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        part = _Part(rows, length, width)
        place, *_, settled = part.sorted(part.surroundings(part.place, part.text))
        value, n = np.unique(part.hashes[place[~settled]], return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(value.view(np.int64)), pa.array(_slots(value)), pa.array(n.astype(np.int64))], ["anchor", "slot", "n"]
        )

    return by_slices("text", work)


def _anchor_blocks(length: int, width: int, buckets: int, common: np.ndarray, string_buckets: int):
    """Blocks of anchors by bucket, of (id, text_hash, text).

    Of the texts of a part, only one of equal ones sends anchors. If several texts have the same anchor in the same
    surroundings, the earliest sends it and the others are settled here, so a common passage goes out once a part.
    Instead of ``common`` anchors (bits of their slots), the strings that they are the anchors of are sent likewise,
    to buckets of their own. An anchor that only shares its slot with a common one is sent that way, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                part = _Part(rows, length, width)
                place, text = part.place, part.text
                if len(common):
                    slot = _slots(part.hashes[place])
                    is_common = common[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0
                    out = send(part, part.surroundings(place[~is_common], text[~is_common]), 0, buckets)
                    out += send(part, part.strings(place[is_common], text[is_common]), buckets, string_buckets)
                else:
                    out = send(part, part.surroundings(place, text), 0, buckets)
                if out:
                    yield _rows(out, BLOCK)

    def send(part: _Part, found: tuple[np.ndarray, ...], base: int, buckets: int) -> list[tuple]:
        at, ids, text_hash = part.at, part.ids, part.text_hash
        place, text, low, high, anchor, around, settled = part.sorted(found)
        out = []
        if settled.any():
            k = text[settled]
            rows = span_rows(k, low[settled] - at[k], high[settled] - at[k])
            for t, s, e in zip(rows[0].tolist(), rows[1].to_pylist(), rows[2].to_pylist(), strict=True):
                out.append((-1 - t, None, None, None, None, s, e, ids[t].tobytes(), text_hash[t].tobytes()))
        keep = ~settled
        place, text, low, high, anchor, around = (x[keep] for x in (place, text, low, high, anchor, around))
        bucket = ((anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own, index = np.unique(text[a:b], return_inverse=True)
            out.append(
                (
                    base + int(bucket[a]),
                    pack48(anchor[a:b]),
                    pack48(around[a:b]),
                    index.astype("<u4" if len(own) > 1 << 16 else "<u2").tobytes(),
                    (place[a:b] - at[text[a:b]]).astype("<u4").tobytes(),
                    (place[a:b] - low[a:b]).astype(np.uint8).tobytes(),
                    (high[a:b] - place[a:b]).astype(np.uint8).tobytes(),
                    ids[own].tobytes(),
                    text_hash[own].tobytes(),
                )
            )
        return out

    return run


def _settle(buckets: int):
    """From blocks in order of bucket: spans that are settled, and places whose surroundings have to be compared.

    The latter are anchors of which an earlier text has the same, but none in the same surroundings (targets), and
    for each kind of surroundings of such an anchor its earliest text. In buckets from ``buckets`` on are strings, which
    are settled as a whole.
    """

    def settle(blocks: list[dict], compare: bool) -> Iterator[pa.RecordBatch]:
        """A bucket in RANGES parts of its anchors, which are sorted in each block."""
        tops = [np.frombuffer(b["anchors"], "<u4", len(b["anchors"]) // 6) for b in blocks]
        low, high = min(int(t[0]) for t in tops), max(int(t[-1]) for t in tops)
        edges = [low + (high + 1 - low) * k // RANGES for k in range(RANGES + 1)]
        cuts = [np.searchsorted(t, np.array(edges, np.uint64)).tolist() for t in tops]
        ids = [np.frombuffer(b["ids"], np.int64) for b in blocks]
        hashes = [np.frombuffer(b["hashes"], np.int64) for b in blocks]
        base = np.cumsum([0, *map(len, ids)]).tolist()
        ids, hashes = np.concatenate(ids), np.concatenate(hashes)
        # One number for each text, though several blocks may have it.
        *keys, number = distinct_keys(ids, hashes)
        for k in range(RANGES):
            parts = [(b, c[k], c[k + 1], base[j], base[j + 1]) for j, (b, c) in enumerate(zip(blocks, cuts, strict=True))]
            parts = [p for p in parts if p[1] < p[2]]
            if parts:
                yield from settle_range(parts, ids, keys, number, compare)

    def settle_range(
        parts: list[tuple], ids: np.ndarray, keys: list[np.ndarray], number: np.ndarray, compare: bool
    ) -> Iterator[pa.RecordBatch]:
        anchor = np.concatenate([unpack48(b["anchors"], x, y) for b, x, y, _, _ in parts])
        around = np.concatenate([unpack48(b["surroundings"], x, y) for b, x, y, _, _ in parts])
        place = np.concatenate([np.frombuffer(b["place"], "<u4")[x:y] for b, x, y, _, _ in parts]).astype(np.int64)
        lead, tail = (
            np.concatenate([np.frombuffer(b[c], np.uint8)[x:y] for b, x, y, _, _ in parts]) for c in ("lead", "tail")
        )
        text = np.concatenate(
            [
                np.frombuffer(b["text"], "<u4" if to - first > 1 << 16 else "<u2")[x:y].astype(np.int64) + first
                for b, x, y, first, to in parts
            ]
        )
        owner = ids[text]
        order = hash_order(anchor, around, owner)
        anchor, around, place, lead, tail, text, owner = (
            x[order] for x in (anchor, around, place, lead, tail, text, owner)
        )
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        new_kind = new_anchor | np.append(True, around[1:] != around[:-1])
        earliest = np.minimum.reduceat(owner, np.flatnonzero(new_anchor))[np.cumsum(new_anchor) - 1]
        kind_first = owner[np.flatnonzero(new_kind)][np.cumsum(new_kind) - 1]
        settled = owner > kind_first
        target = ~settled & (owner > earliest) & compare
        wanted = np.bincount(np.cumsum(new_anchor) - 1, target) > 0
        source = ~settled & wanted[np.cumsum(new_anchor) - 1] & new_kind
        k = number[text]
        at = place[settled]
        t, starts, ends = span_rows(k[settled], at - lead[settled], at + tail[settled])
        yield _found(_spans(keys[0][t], keys[1][t], starts, ends))
        ask = np.flatnonzero(target | source)
        yield _asked(keys[0][k[ask]], keys[1][k[ask]], place[ask], anchor[ask].view(np.int64), target[ask])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        names = _names(BLOCK)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                block = dict(zip(names, row, strict=True))
                if block["bucket"] < 0:
                    key = (int(np.frombuffer(block[c], np.int64)[0]) for c in ("ids", "hashes"))
                    yield _found(_rows([(*key, block["lead"], block["tail"])], SPANS))
                    continue
                if block["bucket"] != bucket:
                    if held:
                        yield from settle(held, bucket < buckets)
                    bucket, held = block["bucket"], []
                held.append(block)
        if held:
            yield from settle(held, bucket < buckets)

    return run


def ranked(value: np.ndarray) -> np.ndarray:
    """Ranks of ``value`` from 1 on; equal ones share a rank."""
    order = packed_order(value)
    there = value[order]
    rank = np.empty(len(value), np.int64)
    rank[order] = np.cumsum(np.append(np.ones(min(len(value), 1), bool), there[1:] != there[:-1]))
    return rank


def suffix_levels(data: np.ndarray, at: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes of the texts by their first bytes, for a few widths up to ``depth``: (width, ranks).

    Equal ranks share these bytes. By doubling: the order by 2k bytes comes from the order by k bytes here and k bytes
    further on. The first ranks are of as many bytes as fit one number. Suffixes that end earlier come first.
    """
    end = np.repeat(at[1:], np.diff(at))
    here = np.arange(len(data))
    wide = min(depth, 5)  # with the place of a suffix still one number, see packed_order
    first = data.astype(np.int64) + 1
    value = first.copy()
    for k in range(1, wide):
        value *= 257
        value[: len(data) - k] += np.where(here[: len(data) - k] + k < end[: len(data) - k], first[k:], 0)
    rank, done = ranked(value), wide
    levels = [(done, rank)]
    while done < depth:
        step = min(done, depth - done)
        there = here + step
        second = np.where(there < end, rank[np.minimum(there, len(rank) - 1)], 0)
        rank = ranked(rank * (int(rank.max()) + 1) + second)
        done += step
        levels.append((done, rank))
    return levels


def suffix_ranks(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` bytes."""
    return suffix_levels(data, at, depth)[-1][1]


def previous_smaller(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Index of the last smaller value before each one, not before ``begin``; -1 if there is none.

    By least values of the last 1, 2, 4, ... places: as many as are not smaller are stepped over, largest steps first.
    """
    place = np.arange(len(value))
    least = [value]
    longest = int((place - begin).max()) if len(value) else 0
    while 1 << len(least) <= longest:
        wider, half = least[-1].copy(), 1 << (len(least) - 1)
        np.minimum(wider[half:], least[-1][:-half], out=wider[half:])
        least.append(wider)
    at = place - 1
    for k in reversed(range(len(least))):
        over = (at - (1 << k) + 1 >= begin) & (least[k][at] >= value)
        at -= over.astype(np.int64) << k
    return np.where(at >= begin, at, -1)


def common_bytes(
    levels: list[tuple[int, np.ndarray]], data: np.ndarray, end: np.ndarray, one: np.ndarray, two: np.ndarray
) -> np.ndarray:
    """How many first bytes suffixes at ``one`` and ``two``, which end at ``end``, have in common, up to the last width."""
    found = np.zeros(len(one), np.int64)
    room = np.minimum(end[one] - one, end[two] - two)
    steps = [(w, r) for w, r in reversed(levels)] + [(1, data)] * (levels[0][0] - 1)
    for width, rank in steps:
        there = np.flatnonzero((found + width <= levels[-1][0]) & (found + width <= room))
        same = rank[one[there] + found[there]] == rank[two[there] + found[there]]
        found[there[same]] += width
    return found


def longest_previous_factors(
    levels: list[tuple[int, np.ndarray]],
    data: np.ndarray,
    at: np.ndarray,
    place: np.ndarray,
    group: np.ndarray,
    owner: np.ndarray,
    asked: np.ndarray,
) -> np.ndarray:
    """For each of the suffixes at ``place``: how much of it also starts in the same group with a smaller owner.

    The suffixes of a group are put in suffix order. Of all with a smaller owner, the nearest before and the nearest
    behind have most in common with a suffix; the longer of the two is its longest previous factor (up to the last
    width). Only those that are ``asked`` for get one, others 0.
    """
    rank = levels[-1][1][place]
    number = np.unique(owner, return_inverse=True)[1].reshape(-1)
    order = packed_order(group, rank, number)
    number = number.astype(np.int32)[order]
    edge = np.append(True, group[order][1:] != group[order][:-1])
    begin = np.flatnonzero(edge)[np.cumsum(edge) - 1]
    last = np.append(np.flatnonzero(edge)[1:], len(order))[np.cumsum(edge) - 1]
    before = previous_smaller(number, begin)
    behind = previous_smaller(number[::-1], len(order) - last[::-1])[::-1]
    behind = np.where(behind >= 0, len(order) - 1 - behind, -1)
    end = np.repeat(at[1:], np.diff(at))
    out = np.zeros(len(place), np.int64)
    for near in (before, behind):
        k = np.flatnonzero((near >= 0) & asked[order])
        one, two = order[k], order[near[k]]
        out[one] = np.maximum(out[one], common_bytes(levels, data, end, place[one], place[two]))
    return out


AROUND = "bucket bigint, anchor binary, id binary, text_hash binary, place binary, lead binary, target binary, size binary, bytes binary"


def _surroundings(length: int, width: int, buckets: int):
    """Bytes around the places asked for, in blocks by bucket, from (id, text_hash, text, places, anchors, targets)."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = utf8(part.column(2))
        counts = pc.list_value_length(part.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = [part.column(k).flatten().to_numpy(zero_copy_only=False) for k in (3, 4, 5)]
        text = np.repeat(np.arange(part.num_rows), counts)
        place = flat[0] + at[text]
        low, high = np.maximum(place - length + width, at[text]), np.minimum(place + length, at[text + 1])
        ids, hashes = (part.column(k).to_numpy(zero_copy_only=False)[text] for k in (0, 1))
        bucket = (((flat[1].astype(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            k = order[a:b]
            size = high[k] - low[k]
            byte = data[np.repeat(low[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            lists = (flat[1][k], ids[k], hashes[k], flat[0][k], place[k] - low[k], flat[2][k], size)
            out.append((int(bucket[k[0]]), *[x.astype(np.int64).tobytes() for x in lists], byte.tobytes()))
        return _rows(out, AROUND)

    return by_slices("text", work)


def _compare(length: int):
    """Spans of targets, from surroundings in order of bucket."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, ids, hashes, place, lead, target, size = (
            np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in range(1, 8)
        )
        data = np.frombuffer(b"".join(r[8] for r in rows), np.uint8)
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        order = np.argsort(anchor, kind="stable")
        # Whole groups of anchors, as many as fit.
        most = min(SORT_BYTES, SUFFIX_BYTES)
        sums = np.cumsum(size[order])
        edge = np.append(np.flatnonzero(np.diff(anchor[order], prepend=anchor[order[0]] - 1)), len(order))
        begin = 0
        while begin < len(edge) - 1:
            base = sums[edge[begin] - 1] if edge[begin] else 0
            end = max(begin + 1, int(np.searchsorted(sums[edge[1:] - 1], base + most)))
            k = order[edge[begin] : edge[end]]
            begin = end
            n = size[k]
            to = np.zeros(len(k) + 1, np.int64)
            np.cumsum(n, out=to[1:])
            own = data[np.repeat(at[k] - to[:-1], n) + np.arange(to[-1])]
            levels = suffix_levels(own, to, length)
            row = np.repeat(np.arange(len(k)), n)
            start = np.arange(len(own)) - to[row]
            full = np.flatnonzero(start + length <= n[row])
            row, start = row[full], start[full]
            # Suffixes of a group meet if they start equally far before their anchor.
            group = np.unique(anchor[k], return_inverse=True)[1].reshape(-1)[row] * (length + 1) + lead[k][row] - start
            factors = longest_previous_factors(levels, own, to, full, group, ids[k][row], target[k][row] > 0)
            hit = factors >= length
            row, start = row[hit], start[hit]
            *key, number = distinct_keys(ids[k], hashes[k])
            begin_at = place[k][row] - lead[k][row] + start
            t, starts, ends = span_rows(number[row], begin_at, begin_at + length)
            yield _spans(key[0][t], key[1][t], starts, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != bucket:
                    if held:
                        yield from settle(held)
                    bucket, held = row[0], []
                held.append(row)
        if held:
            yield from settle(held)

    return run


def repeated_spans(documents: DataFrame, length: int = LENGTH, width: int = ANCHOR) -> DataFrame:
    """(id, text_hash, starts, ends): for texts with repeats, what to remove, in pieces that may overlap.

    ``id`` is doc_id, or NO_ID if that is null; ``text_hash`` is Spark's xxhash64 of the text.
    """
    rows = documents.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    rows = rows.where(F.octet_length("text") >= length)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, total // ((length - width + 2) // 2) // BUCKET_ENTRIES)
    # A text that an earlier document has as a whole goes as a whole.
    sizes = rows.select(*KEYS, F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("n"))
    first = sizes.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = sizes.join(first, "digest").where("id > first").select(
        *KEYS, _number(F.lit(0)).alias("starts"), _number(F.col("n")).alias("ends")
    )
    common, strings = _common_anchors(rows, length, width)
    string_buckets = max(16, strings // BUCKET_ENTRIES)
    blocks = rows.mapInArrow(_anchor_blocks(length, width, buckets, common, string_buckets), BLOCK)
    found = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settle(buckets), FOUND)
    found = stored(found, "anchors")
    asked = found.where("anchor is not null").groupBy(*KEYS).agg(
        F.collect_list(F.struct("place", "anchor", "target")).alias("asked")
    )
    asked = rows.join(asked, KEYS).select(
        *KEYS, "text", F.col("asked.place"), F.col("asked.anchor"), F.col("asked.target")
    )
    around = asked.mapInArrow(_surroundings(length, width, buckets), AROUND)
    compared = around.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare(length), SPANS)
    settled = found.where("anchor is null").select(*KEYS, "starts", "ends")
    return settled.unionByName(stored(compared, "compared")).unionByName(stored(copies, "copies"))


def _common_anchors(rows: DataFrame, length: int, width: int) -> tuple[np.ndarray, int]:
    """Bits of the slots of anchors of which more rows would meet than SUFFIX_BYTES hold, and about how many strings
    they have.

    Counted are texts whose hash is 0 modulo SAMPLE, so that counts are estimates; they decide how strings meet, not
    which are repeats. The bound is the same at any size of the corpus, and so is the number of bits: 2^SLOT_BITS, of
    which words of 32 come to the driver (2^19 rows at most). A slot that several anchors share makes all of them common.
    """
    most = max(1, SUFFIX_BYTES // (2 * length - width) // SAMPLE)
    sample = rows.where(F.pmod("text_hash", F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(_counted(length, width), "anchor bigint, slot bigint, n bigint")
    counts = counts.groupBy("anchor", "slot").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    one = F.expr("shiftleft(1L, cast(slot % 32 as int))")
    words = counts.groupBy(F.floor(F.col("slot") / 32).alias("word")).agg(F.bit_or(one).alias("bits"), F.sum("n").alias("n"))
    with small_batches(rows.sparkSession):
        words = words.collect()
    if not words:
        return np.zeros(0, np.uint8), 0
    common = np.zeros(1 << (SLOT_BITS - 5), "<u4")
    common[[w["word"] for w in words]] = np.array([w["bits"] for w in words], np.int64).astype(np.uint32)
    return common.view(np.uint8), sum(w["n"] for w in words) * SAMPLE * (length - width + 2) // 2


def _number(x: Column) -> Column:
    """A number as the 8 bytes in which spans hold it (lowest byte first)."""
    digits = F.lpad(F.hex(x.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))


def _with_spans(documents: DataFrame, length: int, width: int) -> DataFrame:
    """``documents`` with (STARTS, ENDS), arrays of binary pieces, null where nothing is repeated."""
    spans = repeated_spans(documents, length, width).groupBy(*KEYS).agg(
        F.collect_list("starts").alias(STARTS), F.collect_list("ends").alias(ENDS)
    )
    spans = spans.withColumnsRenamed({"id": "_span_id", "text_hash": "_span_hash"})
    return documents.join(
        spans,
        (F.coalesce(documents["doc_id"], F.lit(NO_ID)) == spans["_span_id"])
        & (F.xxhash64(documents["text"]) == spans["_span_hash"]),
        "left",
    )


def _cut(raw: bytes, starts: list[bytes] | None, ends: list[bytes] | None) -> tuple[bytes, int, int]:
    """(what is left, number of bytes removed, number of removed runs)."""
    if not starts:
        return raw, 0, 0
    s, e = runs(np.frombuffer(b"".join(starts), "<i8"), np.frombuffer(b"".join(ends), "<i8"))
    inner = zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)
    return b"".join([raw[a:b] for a, b in inner]), int((e - s).sum()), len(s)


def remove_repeats(documents: DataFrame, length: int = LENGTH, width: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``documents`` (doc_id, text).

    Removed is each byte covered by ``length`` bytes that also start in a document with a smaller doc_id; a null
    doc_id counts as the largest. A null text is empty; rows with the same doc_id don't remove each other's bytes, so
    repeated rows have the same result. Texts of any length; other columns are not read.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = utf8(part.column(1))
        raw, edges = data.tobytes(), at.tolist()
        cut = [
            _cut(raw[a:b], s, e)
            for a, b, s, e in zip(
                edges[:-1], edges[1:], part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True
            )
        ]
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(np.diff(at)),
                pa.array([c[1] for c in cut], pa.int64()),
                pa.array([c[2] for c in cut], pa.int64()),
                pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut], pa.string()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    rows = _with_spans(documents.select("doc_id", "text"), length, width).select("doc_id", "text", STARTS, ENDS)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return rows.mapInArrow(by_slices("text", work), schema)


def without_repeats(documents: DataFrame, length: int = LENGTH, width: int = ANCHOR) -> DataFrame:
    """``documents`` with all its columns, ``text`` without repeats, and ``n_chars``, if it is there, to match.

    Of a character cut in two nothing stays; a null text stays null, with its ``n_chars`` as it is.
    """
    names = documents.columns

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [
            t if t is None or not s else _cut(t.encode(), s, e)[0].decode("utf-8", "ignore")
            for t, s, e in zip(*[part.column(c).to_pylist() for c in ("text", STARTS, ENDS)], strict=True)
        ]
        columns = []
        for name in names:
            column = part.column(name)
            if name == "text":
                column = pa.array(texts, pa.string())
            elif name == "n_chars":
                counts = zip(texts, column.to_pylist(), strict=True)
                column = pa.array([n if t is None else len(t) for t, n in counts], column.type)
            columns.append(column)
        return pa.RecordBatch.from_arrays(columns, names)

    rows = _with_spans(documents, length, width).select(*[documents[c] for c in names], STARTS, ENDS)
    return rows.mapInArrow(by_slices("text", work), documents.schema)

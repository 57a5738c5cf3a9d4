"""Language identification by rank-order profiles of byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrust.llm.tokens import UPPER_LATIN
from citetrust.llm.words import LOWER
from citetrust.llm.work import SMALL_SLICE_BYTES, by_slices, held_out, slices, small_batches, utf8

PART_BYTES = SMALL_SLICE_BYTES  # of text at a time; its n-grams take some 60 times as much
RANKS = 300  # n-grams of a profile
UNKNOWN = "und"
LEAST = 0.1  # score of a text that is taken to be in its language

LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[0x80:] = True


def folded(data: np.ndarray) -> np.ndarray:
    """``data`` without the case of ASCII and Latin letters."""
    low = LOWER[data]
    upper = np.zeros(len(low), bool)
    upper[1:] = (low[:-1] == 0xC3) & UPPER_LATIN[low[1:]]
    low[upper] += 0x20
    return low


def kinds(padded: np.ndarray, starts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of 1, 2 and 3 bytes that begin among the first ``starts`` bytes, and where."""
    solid = padded != 0x20
    one = np.flatnonzero(solid[:starts])
    found = [(padded[one] | 1 << 8, one)]
    two = np.flatnonzero((solid[:-1] | solid[1:])[:starts])
    found.append((padded[two] << 8 | padded[two + 1] | 1 << 16, two))
    if len(padded) >= 3:
        three = np.flatnonzero(solid[1:-1][:starts])
        found.append((padded[three] << 16 | padded[three + 1] << 8 | padded[three + 2] | 1 << 24, three))
    return found


def ngrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 bytes within words, with a blank at both ends of a word, and where each text's begin.

    Words are runs of letters; letters are a-z, after dropping the case of ASCII and Latin letters, and all bytes
    from 0x80 on. An n-gram is its bytes as one number, with a bit for its length above them.
    """
    low = folded(data)
    letter = LETTER[low]
    # A blank goes before each text and after the last; other bytes that aren't letters are blanks, too.
    place = np.arange(len(low)) + np.repeat(np.arange(1, len(at)), np.diff(at))
    padded = np.full(len(low) + len(at), 0x20, np.int32)
    padded[place[letter]] = low[letter]
    edge = at + np.arange(len(at))
    found = kinds(padded, len(padded))
    # Each kind is in the order of texts; put the kinds of a text side by side.
    bounds = [np.searchsorted(where, edge) for _, where in found]
    total = sum(bounds)
    out = np.empty(int(total[-1]), np.int32)
    before = total.copy()
    for (codes, _), b in zip(found, bounds, strict=True):
        sizes = np.diff(b)
        to = np.repeat(before[:-1] - b[:-1], sizes) + np.arange(len(codes))
        out[to] = codes
        before[:-1] += sizes
    return out, total


Counts = tuple[np.ndarray, np.ndarray]  # n-grams in order, and how often each comes


def added(a: Counts | None, b: Counts) -> Counts:
    if a is None:
        return b
    codes, index = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return codes, np.bincount(index, np.concatenate([a[1], b[1]])).astype(np.int64)


def counted(data: np.ndarray, size: int) -> Counts:
    """The n-grams of one text, however long, counted ``size`` bytes at a time.

    A part takes the two bytes behind it along, so that each n-gram counts once, where it begins. Besides the text this
    needs memory for one part and for the different n-grams, of which letters form less than 4 million.
    """
    n = len(data) + 2  # with a blank at both ends
    sums = None
    for begin in range(0, n, size):
        end = min(begin + size, n)
        behind = min(end + 2, n)
        first, last = max(begin - 1, 0), min(behind - 1, len(data))
        lead = min(first, 1)  # the case of a byte depends on the one before it
        low = folded(data[first - lead : last])[lead:]
        padded = np.full(behind - begin, 0x20, np.int32)
        padded[first + 1 - begin : last + 1 - begin] = np.where(LETTER[low], low, 0x20)
        codes = np.concatenate([c for c, _ in kinds(padded, end - begin)])
        sums = added(sums, np.unique(codes, return_counts=True))
    return sums


def most_frequent(codes: np.ndarray, at: np.ndarray, ranks: int = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of each text, the smaller number first among equals, and where each text's begin."""
    found, begin = [], [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = codes[a:b]
        own.sort()
        first = np.flatnonzero(np.diff(own, prepend=-1))
        often = np.diff(np.append(first, b - a))
        top = np.argsort(-often, kind="stable")[:ranks]
        found.append(own[first[top]])
        begin.append(begin[-1] + len(top))
    return (np.concatenate(found) if found else codes[:0]), np.array(begin)


def profiles_of(data: np.ndarray, at: np.ndarray, ranks: int = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of each text and where each text's begin; a long text is counted in parts."""
    if len(at) == 2 and len(data) > PART_BYTES:
        codes, often = counted(data, PART_BYTES)
        top = codes[np.argsort(-often, kind="stable")[:ranks]]
        return top, np.array([0, len(top)])
    return most_frequent(*ngrams(data, at), ranks)


def learn_profiles(labelled: DataFrame, ranks: int = RANKS) -> dict[str, list[int]]:
    """The profile of each language in ``labelled`` (text, lang): its most frequent n-grams over all its texts.

    Counts are added up in each task and then by Spark; only the profiles go to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counts] = {}
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                data, at = utf8(part.column(0))
                if part.num_rows == 1 and len(data) > PART_BYTES:
                    lang = part.column(1)[0].as_py()
                    sums[lang] = added(sums.get(lang), counted(data, PART_BYTES))
                    continue
                codes, at = ngrams(data, at)
                langs = np.array(part.column(1).to_pylist(), object)
                text = np.repeat(np.arange(part.num_rows), np.diff(at))
                for lang in set(langs.tolist()):
                    sums[lang] = added(sums.get(lang), np.unique(codes[(langs == lang)[text]], return_counts=True))
        for lang, (own, n) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own), pa.string()), pa.array(own, pa.int32()), pa.array(n, pa.int64())],
                ["lang", "code", "n"],
            )

    counts = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counts = counts.mapInArrow(count, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= ranks)
    profiles: dict[str, list[int]] = {}
    with small_batches(labelled.sparkSession):
        rows = best.orderBy("lang", "rank").collect()
    for row in rows:
        profiles.setdefault(row["lang"], []).append(row["code"])
    return profiles


def out_of_place(top: np.ndarray, begin: np.ndarray, profile: list[int], ranks: int = RANKS) -> np.ndarray:
    """Each text's distance to a profile: differences of rank added up, ``ranks`` for an n-gram that it lacks."""
    codes = np.array(profile, np.int64)
    order = np.argsort(codes)
    codes = codes[order]
    at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
    rank = np.arange(len(top)) - np.repeat(begin[:-1], np.diff(begin))
    far = np.where(codes[at] == top, np.abs(order[at] - rank), ranks)
    sums = np.zeros(len(top) + 1, np.int64)
    np.cumsum(far, out=sums[1:])
    return sums[begin[1:]] - sums[begin[:-1]]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def predict(texts: pa.Array, profiles: dict[str, list[int]], ranks: int = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """The predicted language of each text, and its score."""
    names = sorted(profiles)
    data, at = utf8(texts)
    top, begin = profiles_of(data, at, ranks)
    letters = np.zeros(len(texts), bool)
    for a in range(0, len(data), PART_BYTES):
        plain = a + np.flatnonzero((LETTER[LOWER[data[a : a + PART_BYTES]]]) & (data[a : a + PART_BYTES] < 0x80))
        letters |= np.diff(np.searchsorted(plain, at)) > 0
    for k in np.flatnonzero(~letters).tolist():
        letters[k] = at[k + 1] > at[k] and has_letter(texts[k].as_py())
    size = np.diff(begin)
    known = letters & (size > 0) & bool(names)
    pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if names:
        far = np.stack([out_of_place(top, begin, profiles[n], ranks) for n in names])
        pred[known] = np.array(names, object)[far.argmin(0)[known]]
        score[known] = 1 - far.min(0)[known] / (size[known] * ranks)
    return pred, score


def identify(documents: DataFrame, profiles: dict[str, list[int]], ranks: int = RANKS) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``documents`` (doc_id, text): the language with the nearest profile.

    ``score`` is 1 for a text ranked as the profile is, 0 for one without any of its n-grams. Equally near languages:
    the first by name. A null text, one without a letter, or no profile at all gives ``und`` and 0. Null ids stay
    null, repeated rows are judged each, other columns are not read. One scan, no shuffle. A text over 256 KB is counted
    in parts: it takes a worker its own bytes and a bounded rest.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        pred, score = predict(part.column(1), profiles, ranks)
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
        )

    return documents.select("doc_id", "text").mapInArrow(
        by_slices("text", work, PART_BYTES), "doc_id bigint, lang_pred string, score double"
    )


def learn_and_identify(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): profiles are learned from all rows that aren't held out."""
    profiles = learn_profiles(documents.where(~held_out(F.col("doc_id"))))
    found = identify(documents, profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def understood(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``documents``, with all their columns, in one of the languages learned from them.

    Rejected are texts without a letter and those that have next to nothing in common with any profile. If nothing
    can be learned, all rows stay.
    """
    profiles = learn_profiles(documents.where(~held_out(F.col("doc_id"))))
    if not profiles:
        return documents
    text = documents.columns.index("text")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        pred, score = predict(part.column(text), profiles)
        return part.filter(pa.array((pred != UNKNOWN) & (score >= least)))

    return documents.mapInArrow(by_slices("text", work, PART_BYTES), documents.schema)

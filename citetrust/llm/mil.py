"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrust.llm.words import Rolling, spans
from citetrust.llm.work import SMALL_SLICE_BYTES, by_slices, held_out, utf8

PASSAGE = 64  # words
BUCKETS = 32  # of hashed words
SAMPLE = 1000  # documents of each label that are learned from
PASSAGES = 100_000  # passages of each label that are learned from
HIDDEN, GATE = 24, 12
STEPS, RATE, DECAY = 250, 0.02, 1e-4
ACCEPT = 0.7

# Classes of bytes that are counted: other, lower, upper, digit, blank, line end, then marks, then bytes from 0x80.
KINDS = np.zeros(256, np.uint8)
KINDS[ord("a") : ord("z") + 1] = 1
KINDS[ord("A") : ord("Z") + 1] = 2
KINDS[ord("0") : ord("9") + 1] = 3
KINDS[[0x20, 0x09]] = 4
KINDS[[0x0A, 0x0D]] = 5
for _k, _marks in enumerate((".", ",", "!?", ";:", "|", "#*$%&<>", "'\"()[]{}", "-_/\\=+~^@"), 6):
    KINDS[[ord(c) for c in _marks]] = _k
KINDS[0x80:] = 14
N_KINDS = 15
FEATURES = N_KINDS + 5 + BUCKETS


def passages(data: np.ndarray, at: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of ``size`` words, and where each text's passages begin.

    A text without words is one passage without features. Features: shares of kinds of bytes; words, their length,
    share of distinct words and of words equal to the one before, marks in a word; logarithms of hashed word counts.
    """
    begin, end, first = spans(data, at)
    words = np.diff(first)
    count = np.maximum(-(-words // size), 1)
    to = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=to[1:])
    n = int(to[-1])
    if not n:
        return np.zeros((0, FEATURES), np.float32), to
    text = np.repeat(np.arange(len(words)), words)
    passage = to[:-1][text] + (np.arange(len(begin)) - first[:-1][text]) // size
    rows = np.zeros((n, FEATURES), np.float32)
    if len(begin):
        head = np.flatnonzero(np.diff(passage, prepend=-1))  # the first word of each passage that has words
        edges = np.append(begin[head], len(data))
        ends = np.minimum(edges[1:], at[1:][text[head]])
        owner = np.repeat(passage[head], ends - edges[:-1])
        within = np.zeros(len(data) + 1, np.int8)
        within[edges[:-1]] += 1
        np.add.at(within, ends, -1)
        inside = np.cumsum(within[:-1]) > 0
        kinds = np.bincount(owner * N_KINDS + KINDS[data[inside]], minlength=n * N_KINDS).reshape(n, N_KINDS)
        chars = np.maximum(kinds.sum(1, keepdims=True), 1)
        rows[:, :N_KINDS] = np.sqrt(kinds / chars)
        own = np.maximum(np.bincount(passage, minlength=n), 1)
        hashes = Rolling(data).of(begin, end)
        rows[:, N_KINDS] = np.log1p(np.bincount(passage, minlength=n)) / 4
        rows[:, N_KINDS + 1] = np.bincount(passage, end - begin, n) / own / 8
        key = np.sort((hashes >> np.uint64(28)) | (passage.astype(np.uint64) << np.uint64(36)))
        fresh = key[np.flatnonzero(np.append(True, key[1:] != key[:-1]))] >> np.uint64(36)
        rows[:, N_KINDS + 2] = np.bincount(fresh.astype(np.int64), minlength=n) / own
        same = np.zeros(len(begin))
        same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        rows[:, N_KINDS + 3] = np.bincount(passage, same, n) / own
        rows[:, N_KINDS + 4] = kinds[:, 6:14].sum(1) / own / 2
        bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        hashed = np.bincount(passage * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
        rows[:, N_KINDS + 5 :] = np.log1p(hashed) / 2
    return rows, to


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """A passage's representation h = tanh(x W + b); its weight in the document is the softmax, over the document's
    passages, of (tanh(h V) * sigmoid(h U)) a; the score is the sigmoid of the weighted mean of h, times c, plus d."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, to: np.ndarray) -> dict[str, np.ndarray]:
        w, first, size = self.weights, to[:-1], np.diff(to)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        e = (t * g) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        weight = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(weight[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "z": z, "score": sigmoid(z @ w["c"] + w["d"])}

    def score(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return self.forward(x, to)["score"] if len(to) > 1 else np.zeros(0)


def fit(x: np.ndarray, to: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Learns from documents' labels by full-batch gradient steps (Adam) on the weighted log loss."""
    random = np.random.default_rng(seed)
    normal = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {
        "W": normal(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": normal(HIDDEN, GATE), "U": normal(HIDDEN, GATE),
        "a": normal(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1),
    }
    model = Model(x.mean(0), x.std(0) + 0.05, weights)
    first, size = to[:-1], np.diff(to)
    bag = np.repeat(np.arange(len(size)), size)
    weight = weight / weight.sum()
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    for step in range(1, STEPS + 1):
        f = model.forward(x, to)
        h, t, g, share = f["h"], f["t"], f["g"], f["weight"]
        err = weight * (f["score"] - label)
        dz = err[:, None] * weights["c"]
        dshare = (dz[bag] * h).sum(1)
        de = share * (dshare - np.add.reduceat(share * dshare, first)[bag])
        dt, dg = de[:, None] * weights["a"] * g * (1 - t * t), de[:, None] * weights["a"] * t * g * (1 - g)
        dh = share[:, None] * dz[bag] + dt @ weights["V"].T + dg @ weights["U"].T
        dp = dh * (1 - h * h)
        slope = {
            "W": f["x"].T @ dp, "b": dp.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de,
            "c": f["z"].T @ err, "d": err.sum(keepdims=True),
        }
        for k, grad in slope.items():
            grad = grad + DECAY * weights[k]
            m, v = moment[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            weights[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return model


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from at most ``sample`` documents of each label: those with the smallest hash of their id.

    They are fewer, in this order, if they have more than PASSAGES passages; a document that alone has more is not
    learned from. Of several rows with the same id, one counts, that with the smallest hash of its text.
    ``documents`` (doc_id, text), ``labels`` (doc_id, quality). Held-out ids are left out, so are null labels and ids
    with both labels. The sample's passages, of whole texts, go to the driver; the two labels are weighted by how
    often all labelled rows have them. None if a label has no document.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64("doc_id").alias("place")
    picked = [
        known.where(F.col("quality") == q).select("quality", place, "doc_id").orderBy("place", "doc_id").limit(sample)
        for q in (0, 1)
    ]
    picked = sorted(picked[0].unionByName(picked[1]).collect())

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        n = np.maximum(-(-np.diff(spans(*utf8(part.column(2)))[2]) // PASSAGE), 1)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["doc_id", "text_hash", "n"])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, to = passages(*utf8(part.column(2)))
        cut = [rows[a:b].tobytes() for a, b in zip(to[:-1], to[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cut, pa.binary())], ["doc_id", "text_hash", "rows"])

    # At most 2 * sample ids, as a literal set that the scan can filter by.
    texts = documents.where(F.col("doc_id").isin([r["doc_id"] for r in picked]))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    counts = texts.mapInArrow(by_slices("text", count, SMALL_SLICE_BYTES), "doc_id bigint, text_hash bigint, n bigint")
    sizes = {r["doc_id"]: r["one"] for r in counts.groupBy("doc_id").agg(F.min(F.struct("text_hash", "n")).alias("one")).collect()}
    chosen, taken = {}, [0, 0]
    for quality, _, doc_id in picked:
        n = sizes[doc_id]["n"] if doc_id in sizes else PASSAGES + 1
        if n <= PASSAGES:
            taken[quality] += n
            if taken[quality] <= PASSAGES:
                chosen[doc_id] = quality
    texts = texts.where(F.col("doc_id").isin(list(chosen)) & F.col("text_hash").isin([sizes[k]["text_hash"] for k in chosen]))
    # An id may have the text of another one, too; of its own rows the smallest hash counts.
    bags = texts.mapInArrow(by_slices("text", work, SMALL_SLICE_BYTES), "doc_id bigint, text_hash bigint, rows binary")
    bags = bags.groupBy("doc_id").agg(F.min_by("rows", F.struct("text_hash", "rows")).alias("rows")).collect()
    bags.sort(key=lambda r: r["doc_id"])
    label = np.array([chosen[r["doc_id"]] for r in bags], float)
    if not len(label) or label.min() == label.max():
        return None
    cut = [np.frombuffer(bytes(r["rows"]), np.float32).reshape(-1, FEATURES) for r in bags]
    to = np.zeros(len(cut) + 1, np.int64)
    np.cumsum([len(c) for c in cut], out=to[1:])
    weight = np.where(label == 1, share[1] / label.sum(), share[0] / (1 - label).sum())
    return fit(np.concatenate(cut).astype(np.float64), to, label, weight)


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of each row of ``documents`` (doc_id, text); one scan, no shuffle.

    A null or empty text is scored as a passage without features; without a model every score is 0.5. Null ids stay
    null, repeated rows are scored each, other columns are not read.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, to = passages(*utf8(part.column(1)))
        found = model.score(rows.astype(np.float64), to) if model else np.full(part.num_rows, 0.5)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(by_slices("text", work, SMALL_SLICE_BYTES), "doc_id bigint, score double")


def quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``documents``, learned from ``labels``."""
    return score(documents, learn(documents, labels, sample)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def accepted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``documents``, with all their columns, that score ``accept`` or more; all rows without a model."""
    model = learn(documents, labels, sample)
    if model is None:
        return documents
    text = documents.columns.index("text")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, to = passages(*utf8(part.column(text)))
        return part.filter(pa.array(model.score(rows.astype(np.float64), to) >= accept))

    return documents.mapInArrow(by_slices("text", work, SMALL_SLICE_BYTES), documents.schema)

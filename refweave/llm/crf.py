"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. Its emission score sums one weight per binned feature
of the line itself, of the line before and of the line after; transitions tie
neighbouring labels. Training maximises the likelihood of line labels taken from
labelled documents (every line of a document carries its label). A document's
score is the mean of P(line is good), by forward-backward, weighted by length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from refweave.llm import wordset
from refweave.llm.shared import lean, stash

FEATURES = ("length", "word_length", "upper", "digit", "symbol", "bang", "pipe", "stop", "wide", "adjacent", "distinct", "again", "ends", "starts")
SAMPLE = 6000  # labelled documents that training reads at most
LINES = 400_000  # lines of these that training reads at most, in whole documents
BINS = 12
SEGMENT = 64  # lines of a training chain: longer documents are several chains, whose lines know their neighbours beyond the cut
ROUNDS = 120


def _classes() -> np.ndarray:
    out = np.zeros((7, 256), bool)
    out[0, 65:91] = True
    out[1, 48:58] = True
    for c in b"#$%&*+/<=>@\\^_`{}~()[]-":
        out[2, c] = True
    for c in b"!?":
        out[3, c] = True
    out[4, ord("|")] = True
    for c in b".,;:'\"":
        out[5, c] = True
    out[6, 128:] = True
    return out


_CLASSES = _classes()


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, bytes per line, first line of each text and one more) of texts laid end to end."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    breaks = np.flatnonzero(data == 10)
    at = np.searchsorted(breaks, offsets)
    count = np.diff(at) + 1
    first = np.concatenate(([0], np.cumsum(count)))
    n = int(first[-1])
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    text = np.repeat(np.arange(len(count)), count)
    ends = np.empty(n, np.int64)
    ends[:-1] = starts[1:] - 1
    if n:
        ends[first[1:] - 1] = offsets[1:]
    length = ends - starts
    out = np.zeros((len(FEATURES), n), np.float32)
    per = np.maximum(length, 1)
    out[0] = np.log2(length + 1)
    for k in range(7):
        total = np.concatenate(([0], np.cumsum(_CLASSES[k][data], dtype=np.int64)))
        out[2 + k] = (total[ends] - total[starts]) / per
    out[10] = 1
    words, lead = wordset.word_hashes(data, np.concatenate((starts, [len(data)])))
    k = np.diff(lead)
    out[1] = np.where(k > 0, length / np.maximum(k, 1), 0)
    if len(words):
        line = np.repeat(np.arange(n), k)
        same = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
        out[9] = np.bincount(line[1:][same], minlength=n) / np.maximum(k - 1, 1)
        order = np.lexsort((words, line))
        w, l = words[order], line[order]
        fresh = np.concatenate(([True], (w[1:] != w[:-1]) | (l[1:] != l[:-1])))
        out[10] = np.where(k > 0, np.bincount(l[fresh], minlength=n) / np.maximum(k, 1), 1)
        placed = wordset.mix(words + (np.arange(len(words)) - lead[:-1][line]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(placed, dtype=np.uint64)))
        whole = total[lead[1:]] - total[lead[:-1]]
        order = np.lexsort((whole, text))
        w, t = whole[order], text[order]
        again = np.concatenate(([False], (w[1:] == w[:-1]) & (t[1:] == t[:-1])))
        out[11, order] = again & (k[order] > 0)
    full = length > 0
    last, head = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(n, np.uint8), data[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else np.zeros(n, np.uint8)
    out[12] = np.where(full & np.isin(last, np.frombuffer(b".!?", np.uint8)), 1, 0)
    out[13] = np.where(full & ((head >= 65) & (head <= 90) | (head >= 195)), 1, 0)
    return out, length, first


@dataclass
class Crf:
    edges: list[np.ndarray]  # bin bounds of each feature
    weights: np.ndarray  # (3, features, bins): the line, the one before, the one after; the last bin: no such line
    bias: float
    transition: np.ndarray  # (2, 2) from bad, good to bad, good

    def codes(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bin of each feature of the line and its neighbours: (3, features, lines)."""
        own = np.stack([np.searchsorted(e, f, "right") for e, f in zip(self.edges, features)]).astype(np.int64)
        before, after = np.full_like(own, BINS), np.full_like(own, BINS)
        before[:, 1:], after[:, :-1] = own[:, :-1], own[:, 1:]
        before[:, first[:-1]] = BINS
        after[:, first[1:] - 1] = BINS
        return np.stack((own, before, after))

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        total = np.full(codes.shape[2], self.bias)
        for side in range(3):
            for f in range(len(FEATURES)):
                total += self.weights[side, f][codes[side, f]]
        return total

    def good(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals(emission, first, self.transition)[0]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        features, length, first = line_features(data, offsets)
        if not len(length):
            return np.zeros(0)
        good = self.good(self.emissions(self.codes(features, first)), first)
        weight = length + 1.0
        return np.clip(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1)


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) per line, expected transitions (2, 2) and log partition, by forward-backward over all chains at once."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, size = first[:-1][order], count[order]
    n = len(emission)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    step = np.exp(transition)
    local = np.stack((np.zeros(n), emission), 1)
    local -= local.max(1, keepdims=True)
    local = np.exp(local)
    scale = np.ones(n)
    longest = int(size[0]) if len(size) else 0
    for t in range(longest):
        live = begin[: int(np.searchsorted(-size, -t, "left"))] + t
        a = local[live] if t == 0 else (alpha[live - 1] @ step) * local[live]
        s = a.sum(1)
        alpha[live], scale[live] = a / s[:, None], s
    for t in range(longest - 1, -1, -1):
        k = int(np.searchsorted(-size, -t, "left"))
        m = int(np.searchsorted(-size, -(t + 1), "left"))
        live = begin[:k] + t
        b = np.ones((k, 2))
        nxt = begin[:m] + t + 1
        b[:m] = ((beta[nxt] * local[nxt]) @ step.T) / scale[nxt][:, None]
        beta[live] = b
    both = alpha * beta
    good = both[:, 1] / both.sum(1)
    expected = np.zeros((2, 2))
    if pairs:
        inner = np.ones(n, bool)
        inner[first[:-1]] = False
        j = np.flatnonzero(inner)
        joint = alpha[j - 1][:, :, None] * step[None] * (local[j] * beta[j] / scale[j][:, None])[:, None, :]
        expected = joint.sum(0)
    return good, expected, float(np.log(scale).sum())


def cut(first: np.ndarray, label: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and labels of chains of ``segment`` lines at most, from those of documents."""
    starts = [np.arange(a, b, segment) for a, b in zip(first[:-1], first[1:])]
    return np.concatenate([*starts, first[-1:]]).astype(np.int64), np.repeat(label, [len(s) for s in starts])


def train(features: np.ndarray, first: np.ndarray, label: np.ndarray) -> Crf:
    """Fit on documents whose lines all carry the document's label; with no documents every score is 0.5."""
    edges = [np.unique(np.quantile(f, np.linspace(0, 1, BINS)[1:-1])) if f.size else np.zeros(0) for f in features]
    # Shares that are mostly 0 keep a bin of their own for 0.
    edges = [np.unique(np.concatenate((e, [1e-6])))[: BINS - 1] for e in edges]
    model = Crf(edges, np.zeros((3, len(FEATURES), BINS + 1)), 0.0, np.zeros((2, 2)))
    if not len(label):
        return model
    codes = model.codes(features, first)
    first, label = cut(first, label)
    y = np.repeat(label, np.diff(first)).astype(float)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    k = int(y[inner].sum())
    seen = np.diag([inner.sum() - k, k]).astype(float)
    n = float(len(label))
    value = np.zeros(model.weights.size + 5)
    m1, m2 = np.zeros_like(value), np.zeros_like(value)
    for i in range(1, ROUNDS + 1):
        model.weights, model.bias, model.transition = value[:-5].reshape(model.weights.shape), value[-5], value[-4:].reshape(2, 2)
        good, expected, _ = marginals(model.emissions(codes), first, model.transition, pairs=True)
        off = y - good
        grad = np.empty_like(value)
        g = grad[:-5].reshape(model.weights.shape)
        for side in range(3):
            for f in range(len(FEATURES)):
                g[side, f] = np.bincount(codes[side, f], off, BINS + 1)
        grad[-5] = off.sum()
        grad[-4:] = (seen - expected).ravel()
        grad = grad / n - 1e-3 * value
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        value = value + 0.15 * (1 - i / (ROUNDS + 1)) * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-8)
    model.weights, model.bias, model.transition = value[:-5].reshape(model.weights.shape).copy(), float(value[-5]), value[-4:].reshape(2, 2).copy()
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Crf:
    """Train on at most ``sample`` labelled documents of ``lines`` lines in all, those whose doc_id hashes lowest, none of them held out.

    Labels other than 0 and 1 and null doc_ids are passed over; of conflicting
    labels of a doc_id the larger counts. Rows that repeat doc_id and text count
    once, and rows of one doc_id with several texts are several documents. A
    document that would exceed ``lines`` is passed over whole. Texts without
    lines, null ones too, are documents of one empty line; other columns are
    ignored. The executors compute line features; only these come to the
    driver, 56 bytes a line.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = stash(rows.dropDuplicates(["doc_id", "mark"]), "labelled")
    # Ties of a repeated doc_id go by its texts. The limit bounds what the driver sees.
    sizes = rows.select("doc_id", "mark", F.regexp_count("text", F.lit("\n")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(sample).collect()
    wanted, room = [], lines
    for r in sizes:
        if r.n + 1 <= room:
            room -= r.n + 1
            wanted.append((r.doc_id, r.mark))
    picked = F.broadcast(documents.sparkSession.createDataFrame(wanted, "doc_id long, mark long"))

    def run(batches):
        for batch in batches:
            for part in wordset.runs(batch, "text"):
                features, _, first = line_features(*wordset.texts(part.column("text")))
                blobs = [np.ascontiguousarray(features[:, a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), part.column("quality").cast(pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "mark", "quality", "features"])

    got = lean(rows.join(picked, ["doc_id", "mark"])).mapInArrow(run, "doc_id long, mark long, quality int, features binary").toPandas().sort_values(["doc_id", "mark"])
    parts = [np.frombuffer(blob, np.float32).reshape(len(FEATURES), -1) for blob in got["features"]]
    features = np.concatenate(parts, 1) if parts else np.zeros((len(FEATURES), 0), np.float32)
    return train(features, np.concatenate(([0], np.cumsum([p.shape[1] for p in parts]))).astype(np.int64), got["quality"].to_numpy(np.int64))


def score(documents: DataFrame, model: Crf, carry: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``carry`` of ``documents`` (all of them by default) and the score as ``name``, which replaces a column of that name.

    Only the text is an input; null texts score as empty ones, and equal texts
    alike. Null and repeated doc_ids keep their rows. An empty table gives an
    empty frame.
    """
    carry = [c for c in (documents.columns if carry is None else carry) if c.lower() != name.lower()]
    read = list(dict.fromkeys([*carry, "text"]))
    frame = lean(documents.select(*read))

    def run(batches):
        for batch in batches:
            for part in wordset.runs(batch, "text"):
                value = pa.array(model.score(*wordset.texts(part.column("text"))), pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), value], [*carry, name])

    return frame.mapInArrow(run, StructType([frame.schema[c] for c in carry]).add(name, DoubleType()))

"""Quality classifier (10): a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are shares of character classes,
word statistics and repetition, for the line itself and for the lines before
and after it.  A line of a labelled document takes the document's label for
fitting; the forward-backward marginals of the lines, weighted by their
lengths, give the share of good text, and a logistic curve through the
labelled documents turns that into a probability.

Only the fit is bounded: ``FIT_DOCS`` labelled documents, taken in order of a
hash, none of more than ``FIT_LINES`` lines.  Their line features (no text)
are the only thing that reaches the driver.  Scoring reads whole texts.

Defined results: a null or empty text is one empty line; without labelled
documents of both kinds every score is 0.5; repeated rows stay."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, held_out, list_array, ranges, slices, text_rows

FIT_DOCS = 2000
FIT_LINES = 256
FIT_STEPS = 150
THRESHOLD = 0.3
MODULUS = 5
SLICE_BYTES = 1 << 20       # line features take some fifty times the bytes of their text

# Classes of bytes: white space, lower, upper, digit, bar, bang, mark, sign, beyond ASCII.
_CLASS = np.full(256, 8, dtype=np.uint8)
for _code in range(128):
    _c = chr(_code)
    _CLASS[_code] = (0 if _c in " \t\r\x0b\x0c" else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit()
                     else 4 if _c == "|" else 5 if _c == "!" else 6 if _c in ".,;:?\"'()-" else 7)
_CLASS[0xC3] = 9        # leads accented Latin letters; the next byte tells their case
N_SHARES = 9
_ODD = np.uint64(0x9E3779B97F4A7C15)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every non-empty line (of one empty line where there is
    none), lengths of the lines, numbers of lines of the texts."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, dtype=np.uint8)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    end = np.flatnonzero(raw == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    of = np.searchsorted(text_end, end, side="right")       # a text ends with the line end put after it
    filled = np.bincount(of[end > start], minlength=len(texts)) > 0
    first = np.concatenate([[True], of[1:] != of[:-1]])
    keep = (end > start) | (first & ~filled[of])
    start, end, of = start[keep], end[keep], of[keep]
    n, size = len(start), end - start

    kind = _CLASS[raw]
    lead = np.flatnonzero(kind == 9)
    if len(lead):
        follow = raw[np.minimum(lead + 1, len(raw) - 1)]
        case = np.where((follow >= 0x80) & (follow <= 0x9E), 2, 1).astype(np.uint8)
        kind = kind.copy()
        kind[lead] = case
        kind[np.minimum(lead + 1, len(raw) - 1)] = case
        kind[raw == 10] = 7
    # counts by class inside each line from one histogram
    inside = ranges(start, size)
    line = np.repeat(np.arange(n), size)
    counts = np.bincount(line * 16 + kind[inside], minlength=n * 16).reshape(n, 16)[:, :N_SHARES].astype(np.float32)
    share = counts / np.maximum(size, 1)[:, None]

    solid = (kind != 0) & (raw != 10)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], solid.view(np.int8), [0]])))
    w_start, w_end = edge[::2], edge[1::2]
    w_line = np.searchsorted(start, w_start, side="right") - 1
    n_words = np.bincount(w_line, minlength=n).astype(np.float32)
    at = ranges(w_start, w_end - w_start)
    place = (at - np.repeat(w_start, w_end - w_start)).astype(np.uint64) + np.uint64(1)
    value = (raw[at].astype(np.uint64) + np.uint64(257)) * (place * _ODD | np.uint64(1))
    word = np.add.reduceat(value, np.cumsum(w_end - w_start) - (w_end - w_start)) if len(w_start) else np.zeros(0, np.uint64)
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (word[1:] == word[:-1]) & (w_line[1:] == w_line[:-1])
    w_of = of[w_line].astype(np.uint64)
    key = (word ^ (word >> np.uint64(31))) * _ODD + w_of * np.uint64(0xD1B54A32D192ED03)
    order = np.argsort(key, kind="stable")
    seen = np.zeros(len(word), dtype=bool)
    seen[order[1:]] = key[order[1:]] == key[order[:-1]]
    long = (w_end - w_start) >= 7

    def per_line(flag: np.ndarray) -> np.ndarray:
        return np.bincount(w_line, weights=flag, minlength=n).astype(np.float32) / np.maximum(n_words, 1)

    last = kind[np.maximum(end - 1, 0)]
    columns = [np.log1p(size), np.log1p(n_words), np.minimum(size / np.maximum(n_words, 1), 40) / 10,
               per_line(again), per_line(seen & long), per_line(seen), per_line((w_end - w_start) <= 2),
               (last == 6).astype(np.float32), (size == 0).astype(np.float32)]
    own = np.column_stack([np.column_stack(columns), share, np.sqrt(share[:, 2:]), np.sqrt(per_line(again))[:, None],
                           (share[:, [2, 4, 5, 7]] > 0.02)]).astype(np.float32)
    n_lines = np.bincount(of, minlength=len(texts))
    return own, size, n_lines


def with_neighbours(own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Features of a line, the one before and the one after (zero where
    there is none), and a constant."""
    ends = np.cumsum(n_lines)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[(ends - n_lines)[n_lines > 0]] = 0
    after[ends[n_lines > 0] - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], axis=1)


def _steps(n_lines: np.ndarray):
    """Rows of the k-th lines of all texts that have so many, longest first."""
    order = np.argsort(-n_lines, kind="stable")
    first = (np.cumsum(n_lines) - n_lines)[order]
    sorted_lines = n_lines[order]
    for k in range(int(sorted_lines[0]) if len(sorted_lines) else 0):
        yield first[:np.searchsorted(-sorted_lines, -k, side="left")] + k


def marginals(emit: np.ndarray, trans: np.ndarray, n_lines: np.ndarray):
    """Forward-backward over all texts in step: probability that a line is
    good, expected numbers of the four transitions.  ``emit`` scores good
    against bad; ``trans[i, j]`` scores line state i before j."""
    score = np.stack([np.zeros_like(emit), emit], axis=1).astype(np.float64)
    forward, backward = score.copy(), np.zeros_like(score)
    steps = list(_steps(n_lines))
    for before, now in zip(steps, steps[1:]):
        prev = forward[before[:len(now)]]
        forward[now] += np.logaddexp(prev[:, [0]] + trans[0], prev[:, [1]] + trans[1])
    for before, now in zip(steps[-2::-1], steps[:0:-1]):
        nxt = backward[now] + score[now]
        backward[before[:len(now)]] = np.logaddexp(trans[:, 0] + nxt[:, [0]], trans[:, 1] + nxt[:, [1]])
    total = forward + backward
    norm = np.logaddexp(total[:, 0], total[:, 1])
    moves = np.zeros((2, 2))
    inner = np.ones(len(emit), dtype=bool)
    ends = np.cumsum(n_lines)
    inner[ends[n_lines > 0] - 1] = False
    at = np.flatnonzero(inner)
    for i in (0, 1):
        for j in (0, 1):
            moves[i, j] = np.exp(forward[at, i] + trans[i, j] + score[at + 1, j] + backward[at + 1, j] - norm[at]).sum()
    return np.exp(total[:, 1] - norm), moves


@dataclass
class LineModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float

    def share(self, own: np.ndarray, size: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Length-weighted probability of good lines of each text."""
        x = with_neighbours((own - self.mean) / self.scale, n_lines)
        good, _ = marginals(x @ self.weight, self.trans, n_lines)
        weight = size + 1.0
        of = np.repeat(np.arange(len(n_lines)), n_lines)
        return np.bincount(of, weight * good, len(n_lines)) / np.bincount(of, weight, len(n_lines))

    def score(self, own: np.ndarray, size: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.share(own, size, n_lines) - 0.5) + self.offset, -30, 30)))


def fit(own: np.ndarray, size: np.ndarray, n_lines: np.ndarray, label: np.ndarray, steps: int = FIT_STEPS) -> LineModel | None:
    """Fit weights and transitions by gradient ascent (Adam) on the
    likelihood of the line labels, then the logistic curve of the shares."""
    if len(set(label.tolist())) < 2:
        return None
    mean, scale = own.mean(axis=0), own.std(axis=0) + 1e-3
    x = with_neighbours((own - mean) / scale, n_lines)
    y = np.repeat(label, n_lines).astype(np.float64)
    inner = np.repeat(np.arange(len(n_lines)), n_lines)
    same = inner[1:] == inner[:-1]
    moved = np.array([[np.sum(same & (y[:-1] == i) & (y[1:] == j)) for j in (0, 1)] for i in (0, 1)], dtype=np.float64)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weight, trans = theta[:-4], theta[-4:].reshape(2, 2)
        good, moves = marginals(x @ weight, trans, n_lines)
        grad = np.concatenate([x.T @ (y - good), (moved - moves).ravel()]) / len(y) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta += 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    model = LineModel(mean, scale, theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2), 1.0, 0.0)
    share = model.share(own, size, n_lines) - 0.5
    a, b = 4.0, 0.0
    for _ in range(60):                                     # Newton steps with a small prior
        p = 1 / (1 + np.exp(-(a * share + b)))
        w = p * (1 - p) + 1e-6
        h = np.array([[np.sum(w * share * share) + 0.1, np.sum(w * share)], [np.sum(w * share), np.sum(w) + 0.1]])
        g = np.array([np.sum((label - p) * share) - 0.1 * (a - 4.0), np.sum(label - p) - 0.1 * b])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
    model.slope, model.offset = float(a), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          label_id_col: str = "doc_id", modulus: int = MODULUS, fit_docs: int = FIT_DOCS) -> LineModel | None:
    """Fit on at most ``fit_docs`` labelled documents that are not held out."""
    wanted = labels.select(F.col(label_id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")) \
        .where(F.col("label").isin(0, 1) & F.col("l_id").isNotNull() & ~held_out("l_id", modulus)) \
        .groupBy("l_id").agg(F.min("label").alias("label")) \
        .orderBy(F.xxhash64("l_id"), "l_id").limit(fit_docs)
    rows = text_rows(docs, id_col, text_col).join(F.broadcast(wanted), F.col("doc_id") == F.col("l_id")).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=SLICE_BYTES):
            own, size, n_lines = line_features(as_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), list_array(size.astype(np.int32), n_lines), list_array(own.ravel(), n_lines * own.shape[1])],
                ["label", "size", "own"])

    found = rows.mapInArrow(run, "label int, size array<int>, own array<float>") \
        .where(F.size("size") <= FIT_LINES).orderBy(F.xxhash64("own"), "label").limit(fit_docs).toArrow()
    if not found.num_rows:
        return None
    size = found.column("size").combine_chunks()
    n_lines = np.asarray(size.value_lengths(), dtype=np.int64)
    flat = np.asarray(found.column("own").combine_chunks().flatten())
    return fit(flat.reshape(int(n_lines.sum()), -1), np.asarray(size.flatten()), n_lines, np.asarray(found.column("label")))


def score_quality(docs: DataFrame, model: LineModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    rows = text_rows(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=SLICE_BYTES):
            scores = _scores(shared.value, as_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def _scores(model: LineModel | None, texts: list[bytes]) -> np.ndarray:
    return np.full(len(texts), 0.5) if model is None else model.score(*line_features(texts))


def keep_good(docs: DataFrame, model: LineModel | None, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, SLICE_BYTES):
            scores = _scores(shared.value, [t or b"" for t in as_bytes(part.column(text_col))])
            yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)

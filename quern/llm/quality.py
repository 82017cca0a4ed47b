"""Quality: a linear-chain conditional random field over a document's lines.

Each line has features of its own (symbols, separators, capitals, digits,
repetition, word lengths) and those of the lines before and after.  The field
gives every line the marginal probability of being good, by forward-backward
sums; the document's quality is their mean weighted by line length, mapped
to a probability.

The field is trained on at most ``TRAINING_ROWS`` labelled documents outside
the held-out fold, each line bearing its document's label.  Training and
scoring take every line of a document.  Without both labels, ``prior``
weights serve.

Defined cases: a null or empty text is one empty line, scored as such; every
row is scored, repeated rows alike; a null doc_id is in the fold of the empty
text and is never learned from; other columns are kept by ``score`` and
ignored by ``scored``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Adam, as_bytes, logistic, prepare, remainder_of_id, runs, slices, table, training_rows

#: Most labelled rows that the field is learned from.
TRAINING_ROWS = 2_000
ROUNDS = 80
FOLDS, HELD_OUT = 4, 2
GOOD_FROM = 0.7
SYMBOLS = b"%&*#$@^~=+<>{}[]_\\"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
WIDTH = 11


def line_features(line: bytes, seen: set[bytes]) -> list[float]:
    words = line.split()
    n, size = len(words), max(1, len(line))
    again = line in seen
    seen.add(line)
    if not n:
        return [0.0] * (WIDTH - 1) + [1.0]
    letters = len(line) - len(line.translate(None, LETTERS))
    return [
        float(np.log1p(n)) / 5,
        min(1.0, 4 * (len(line) - len(line.translate(None, SYMBOLS))) / size),
        words.count(b"|") / n,
        min(1.0, line.count(b"!") / n),
        (len(line) - len(line.translate(None, CAPITALS))) / max(1, letters),
        (len(line) - len(line.translate(None, DIGITS))) / size,
        1 - len(set(words)) / n,
        sum([a == b for a, b in zip(words, words[1:], strict=False)]) / n,
        min(2.0, size / n / 10),
        float(again and n > 2),
        0.0,
    ]


def line_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, line lengths, and lines by document."""
    rows, sizes, counts = [], [], []
    for t in texts:
        lines, seen = t.split(b"\n"), set()
        rows += [line_features(x, seen) for x in lines]
        sizes += [len(x) + 1 for x in lines]
        counts.append(len(lines))
    return np.array(rows, np.float64).reshape(-1, WIDTH), np.array(sizes, np.float64), np.array(counts, np.int64)


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of all lines with those of the lines before and after, and marks for first and last ones."""
    starts = runs(counts)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[starts[:-1]] = 0
    after[starts[1:] - 1] = 0
    edge = np.zeros((len(own), 3))
    edge[:, 2] = 1
    edge[starts[:-1], 0] = 1
    edge[starts[1:] - 1, 1] = 1
    return np.hstack([own, before, after, edge])


def document_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with those of their neighbours, line lengths, and lines by document."""
    own, sizes, counts = line_table(texts)
    return with_neighbours(own, counts), sizes, counts


@dataclass
class Field:
    """weights: of features for state good (state bad has zero); moves: (2, 2) from state to state; scale: the map from logit to score."""

    weights: np.ndarray
    moves: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of each line P(good); summed over documents the expected moves, and the log normaliser."""
        emit = np.column_stack([np.zeros(len(x)), x @ self.weights])
        starts = runs(counts)[:-1]
        order = np.argsort(-counts, kind="stable")
        n, first = counts[order], starts[order]
        most = int(n[0]) if len(n) else 0
        live = [int(np.searchsorted(-n, -t, "left")) for t in range(most)]  # documents with more than t lines
        step = np.exp(self.moves)
        alpha, beta = np.zeros((len(x), 2)), np.ones((len(x), 2))
        shift = np.zeros(len(x))
        for t in range(most):
            at = first[: live[t]] + t
            e = emit[at]
            top = e.max(1)
            a = np.exp(e - top[:, None]) * (alpha[at - 1] @ step if t else 1.0)
            s = a.sum(1)
            alpha[at] = a / s[:, None]
            shift[at] = top + np.log(s)
        moved = np.zeros((2, 2))
        for t in range(most - 2, -1, -1):
            at = first[: live[t + 1]] + t
            e = emit[at + 1]
            ahead = np.exp(e - shift[at + 1][:, None]) * beta[at + 1]
            beta[at] = ahead @ step.T
            moved += (alpha[at][:, :, None] * step * ahead[:, None, :]).sum(0)
        p = alpha * beta
        return p[:, 1] / p.sum(1), moved, float(shift.sum())

    def quality(self, x: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted mean of P(good) by document, as a logit."""
        good, _, _ = self.marginals(x, counts)
        starts = runs(counts)[:-1]
        mean = np.add.reduceat(good * sizes, starts) / np.add.reduceat(sizes, starts)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.quality(*document_features(texts)) + self.scale[1], -30, 30)))


def prior() -> Field:
    """Symbols, separators, shouting and repetition speak against a line."""
    own = np.array([0.5, -6, -8, -6, -2, -1, -3, -6, 0, -1, 0.0])
    return Field(np.concatenate([own, own / 4, own / 4, [0, 0, 2.0]]), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def train(x: np.ndarray, sizes: np.ndarray, counts: np.ndarray, y: np.ndarray) -> Field:
    """Maximum penalised likelihood of constant line labels, full batches."""
    f = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    label = np.repeat(y, counts)
    weigh = 1 / len(counts)
    best = Adam([f.weights.shape, f.moves.shape], 0.1)
    wanted = np.zeros((2, 2))
    for k in (0, 1):
        wanted[k, k] = (counts[y == k] - 1).sum()
    for _ in range(ROUNDS):
        good, moved, _ = f.marginals(x, counts)
        best.move([f.weights, f.moves], [weigh * (x.T @ (good - label)) + 0.003 * f.weights, weigh * (moved - wanted) + 0.03 * f.moves])
    a, b = logistic(f.quality(x, sizes, counts)[:, None], y)
    return Field(f.weights, f.moves, (float(a), float(b)))


def learn(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Field:
    rows = training_rows(docs, labels, "quality", folds, held_out, limit).select("text", F.col("quality").alias("y"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("y", pa.int32()), ("own", pa.binary()), ("sizes", pa.binary())])
        for part in slices(batches):
            own, sizes, counts = line_table(as_bytes(part.column("text")))
            edges = runs(counts).tolist()
            spans = list(zip(edges, edges[1:], strict=False))
            yield table(schema, part.column("y").to_pylist(), [own[a:b].astype(np.float32).tobytes() for a, b in spans], [sizes[a:b].astype(np.float32).tobytes() for a, b in spans])

    got = rows.mapInArrow(measure, "y int, own binary, sizes binary").collect()  # at most ``limit`` rows of 48 bytes a line
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    y = np.array([r[0] > 0 for r in got], float)
    if not len(y) or y.min() == y.max():
        return prior()
    sizes = [np.frombuffer(bytes(r[2]), np.float32) for r in got]
    counts = np.array([len(s) for s in sizes])
    own = np.frombuffer(b"".join(bytes(r[1]) for r in got), np.float32).reshape(-1, WIDTH).astype(np.float64)
    return train(with_neighbours(own, counts), np.concatenate(sizes).astype(np.float64), counts, y)


def score(docs: DataFrame, field: Field, column: str = "quality_score") -> DataFrame:
    """``docs`` with the score in ``column``, which takes the place of one of that name."""
    prepare(docs.sparkSession)
    docs = docs.drop(column)
    own = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.value.score(as_bytes(part.column("text"))), pa.float64())], names=[*part.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(column, T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    field = learn(docs, labels)
    own = docs.select("doc_id", "text")
    out = score(own, field, "score")
    return out.select("doc_id", (remainder_of_id("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))

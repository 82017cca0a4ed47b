"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes homoglyphs (Cyrillic, Greek, full-width and accented letters)
and digit substitutions, lower-cases, and turns the rest into spaces.  Lexicon
entries are whole words or word beginnings with weights; an exception phrase
hides the entries it covers.  The matched weight is normalised by length and
mapped to a probability.

Weights are log odds of an entry in toxic against other documents, learned
from at most ``TRAINING_ROWS`` labelled rows outside the held-out fold; the
counts are made on executors and only the ``MAX_ENTRIES`` strongest entries
reach the driver.  Exception phrases are learned too, in whatever language:
two words, one of them an entry, that ``LEAST_CLEAN`` clean documents or more
hold and no toxic one.  Without usable labels, ``SEED_WORDS`` with equal
weights, fixed exceptions and a fixed scale serve.

Defined cases: null and empty texts get the score of a document without
matches; every row is scored, repeated rows alike; a null doc_id is in the
fold of the empty text and is never learned from; other columns are kept by
``score`` and ignored by ``scored``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import checkpointed, logistic, prepare, remainder_of_id, slices, table, training_rows

#: Most labelled rows that the lexicon is learned from.
TRAINING_ROWS = 20_000
#: Most entries of the lexicon.
MAX_ENTRIES = 5_000
#: An entry's least log odds.
LEAST_WEIGHT = 2.5
#: Most learned exception phrases, and the clean documents that make one.
MAX_EXCEPTIONS, LEAST_CLEAN = 2_000, 3
PREFIXES = (4, 5, 6, 7)
LONGEST = 24
FOLDS, HELD_OUT = 5, 0

# Common insults, used where no labels are given.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting", "trash", "clown")
# Harmless phrases with a lexicon word in them.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "sore loser", "idiot proof")
# Letters that look like Latin ones, and substitutions.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "b", "æ": "a", "œ": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e",
}


# Marks around words; those that may stand for a first letter stay at the beginning.
OPENING = "([{<\"'*#%&_-/\\.,;:?|"
CLOSING = ")]}>\"'*#%&_-/\\.,;:?|!$@€"


class _Folds(dict):
    """str.translate table; a character's place is worked out when it first comes up."""

    def __missing__(self, code: int) -> str:
        out = LOOK_ALIKES.get(chr(code))
        if out is None:
            plain = unicodedata.normalize("NFKD", chr(code).lower())
            letters = [LOOK_ALIKES.get(c, c) for c in plain if not unicodedata.combining(c)]
            category = unicodedata.category(chr(code))
            out = "" if category in ("Mn", "Cf") else letters[0] if len(letters) == 1 and letters[0].isalpha() else " "
        self[code] = out
        return out


_FOLDS = _Folds()


def fold(text: str) -> str:
    """Folded words, one space before and after each.

    Marks at a word's end and words without any letter go.
    """
    words = []
    for w in text.lower().split():
        if not (w.isascii() and w.isalpha()):
            w = w.lstrip(OPENING).rstrip(CLOSING)
            if not (w.isascii() and w.isalpha()):
                if not any(c.isalpha() for c in w):
                    continue
                w = w.translate(_FOLDS)
        words.append(w)
    return f" {' '.join(' '.join(words).split())} "


def entries_of(folded: str) -> set[str]:
    """What may become an entry: ' word ' and ' beginning'."""
    out = set()
    for w in set(folded.split()):
        n = len(w)
        if 3 <= n <= LONGEST:
            out.add(f" {w} ")
        for k in PREFIXES:
            if n > k:
                out.add(f" {w[:k]}")
    return out


@dataclass(frozen=True)
class Lexicon:
    """Weights by entry, and the logistic map from (matched weight, matched weight per root of length) to a score."""

    weights: dict[str, float]
    scale: tuple[float, float, float]
    exceptions: tuple[str, ...] = field(default=EXCEPTIONS)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, w in self.weights.items():
            a.add_word(e, (len(e), w))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 2, None))
        a.make_automaton()
        return a


SEED = Lexicon({f" {w} ": 4.0 for w in SEED_WORDS}, (-3.0, 2.0, 0.0))


@cache
def _compiled(weights: tuple, exceptions: tuple[str, ...]):
    return Lexicon(dict(weights), (0, 0, 0), exceptions).automaton()


def matched(automaton, folded: str) -> tuple[float, float]:
    """The weight of the matches, and the same over the root of the word count."""
    best: dict[int, float] = {}
    hidden: list[tuple[int, int]] = []
    for end, (n, weight) in automaton.iter(folded):
        at = end - n + 1  # the space before the word
        if weight is None:
            hidden.append((at, end))
        elif weight > best.get(at, 0):
            best[at] = weight
    total = sum(w for at, w in best.items() if not any(a <= at < b for a, b in hidden))
    return total, total / math.sqrt(max(1, folded.count(" ") - 1))


def phrases(automaton, folded: str) -> set[str]:
    """The two-word phrases with a matched word."""
    words = folded.split()
    places, at = {}, 0
    for k, w in enumerate(words):
        places[at] = k  # by the space before the word
        at += len(w) + 1
    hit = {places[end - n + 1] for end, (n, weight) in automaton.iter(folded) if weight is not None}
    return {f"{words[a]} {words[a + 1]}" for k in hit for a in (k - 1, k) if 0 <= a < len(words) - 1}


def features(total: float, dense: float) -> tuple[float, float]:
    return math.log1p(total), math.log1p(10 * dense)


def learn(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Lexicon:
    """A lexicon from ``labels.toxic``; SEED if either label is missing from the training rows."""
    # read twice, so kept: at most ``limit`` rows
    rows = checkpointed(training_rows(docs, labels, "toxic", folds, held_out, limit).select("text", F.col("toxic").alias("y")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("entry", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
        for part in slices(batches):
            seen: list[Counter[str]] = [Counter(), Counter()]
            for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                seen[y > 0].update(entries_of(fold(text)))
                seen[y > 0][""] += 1
            keys = list({*seen[0], *seen[1]})
            yield table(schema, keys, [seen[1][k] for k in keys], [seen[0][k] for k in keys])

    counts = rows.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = checkpointed(counts.where("toxic >= 3 or entry = ''"))
    whole = counts.where("entry = ''").first()
    if whole is None or not whole["toxic"] or not whole["clean"]:
        return SEED
    least = max(3, whole["toxic"] // 400)
    weight = F.log((F.col("toxic") + 0.5) / (whole["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (whole["clean"] + 1))
    best = (
        counts.where((F.col("entry") != "") & (F.col("toxic") >= least)).withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT)
        .orderBy((F.col("w") * F.sqrt("toxic")).desc(), "entry").limit(MAX_ENTRIES).collect()
    )
    # where few labels are given, insults that clean documents don't hold count too
    spoken = {r["entry"] for r in counts.where(F.col("entry").isin(*SEED.weights) & (F.col("clean") * whole["toxic"] > F.col("toxic") * whole["clean"])).collect()}
    weights = {e: LEAST_WEIGHT for e in SEED.weights if e not in spoken}
    lexicon = Lexicon(weights | {r["entry"]: round(float(r["w"]), 6) for r in best}, (0.0, 0.0, 0.0))
    lexicon = Lexicon(lexicon.weights, lexicon.scale, _exceptions(rows, lexicon))
    x, y = _measured(rows, lexicon)
    w = logistic(x, y)
    return Lexicon(lexicon.weights, (float(w[2]), float(w[0]), float(w[1])), lexicon.exceptions)


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """The fixed exceptions, and the phrases that speak for themselves in clean documents: MAX_EXCEPTIONS at most reach the driver."""
    own = rows.sparkSession.sparkContext.broadcast((tuple(lexicon.weights.items()), lexicon.exceptions))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("phrase", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
        automaton = _compiled(*own.value)
        for part in slices(batches):
            seen: list[Counter[str]] = [Counter(), Counter()]
            for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                seen[y > 0].update(phrases(automaton, fold(text)))
            keys = list({*seen[0], *seen[1]})
            yield table(schema, keys, [seen[1][k] for k in keys], [seen[0][k] for k in keys])

    counts = rows.mapInArrow(count, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = counts.where((F.col("toxic") == 0) & (F.col("clean") >= LEAST_CLEAN)).orderBy(F.desc("clean"), "phrase").limit(MAX_EXCEPTIONS).collect()
    return tuple(dict.fromkeys([*lexicon.exceptions, *[r["phrase"] for r in best]]))


def _measured(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the training rows: three numbers a row, at most TRAINING_ROWS rows."""
    own = rows.sparkSession.sparkContext.broadcast((tuple(lexicon.weights.items()), lexicon.exceptions))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.float64()), ("b", pa.float64()), ("y", pa.int32())])
        automaton = _compiled(*own.value)
        for part in slices(batches):
            f = [features(*matched(automaton, fold(t))) for t in part.column("text").to_pylist()]
            yield table(schema, [x for x, _ in f], [x for _, x in f], part.column("y").to_pylist())

    got = np.array([tuple(r) for r in rows.mapInArrow(measure, "a double, b double, y int").collect()], float).reshape(-1, 3)
    return got[:, :2], (got[:, 2] > 0).astype(float)


def score(docs: DataFrame, lexicon: Lexicon, column: str = "toxicity") -> DataFrame:
    """``docs`` with the score in ``column``, which takes the place of one of that name."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(column)
    own = spark.sparkContext.broadcast((tuple(lexicon.weights.items()), lexicon.exceptions, lexicon.scale))  # MAX_ENTRIES bound its size

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, exceptions, (bias, a, b) = own.value
        automaton = _compiled(weights, exceptions)
        for part in slices(batches):
            out = []
            for t in part.column("text").to_pylist():
                x, y = features(*matched(automaton, fold(t or "")))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, bias + a * x + b * y)))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64())], names=[*part.schema.names, column])

    return docs.mapInArrow(measure, T.StructType([*docs.schema, T.StructField(column, T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    lexicon = learn(docs, labels)
    return score(docs.select("doc_id", "text"), lexicon, "score").select("doc_id", (remainder_of_id("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

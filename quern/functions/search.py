"""Full-text search with higher-order functions; no Python on the data's way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.predicates import column

MIN_LENGTH = 2
# Suffixes in the order in which they are tried.
SUFFIXES = ("ing", "ed", "es", "s", "ly", "ness", "ment", "tion", "ation")


def tokens(c, case_sensitive: bool = False, min_length: int = MIN_LENGTH, numbers: bool = True) -> Column:
    """Runs of letters and digits of at least ``min_length``; ``numbers`` False leaves out those of digits alone."""
    text = F.coalesce(column(c), F.lit(""))
    text = text if case_sensitive else F.lower(text)
    out = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) >= min_length)
    return out if numbers else F.filter(out, lambda w: ~w.rlike(r"^\p{N}+$"))


def terms_of(query: str, case_sensitive: bool = False, min_length: int = MIN_LENGTH, numbers: bool = True) -> list[str]:
    import regex

    words = regex.split(r"[^\p{L}\p{N}]+", query if case_sensitive else query.lower())
    return [w for w in words if len(w) >= min_length and (numbers or not w.isnumeric())]


def scan_search(df: DataFrame, query: str, fields: list[str], case_sensitive: bool = False, min_length: int = MIN_LENGTH, score: str = "score") -> DataFrame:
    """Rows in which every term occurs, with a score.

    A field gives a term 10 for each equal token; without one, 5 for each
    token that contains it; without one, 2 if the text contains it.  Rows with
    a match in a searched field ``title`` count half as much again.  No terms,
    no rows.
    """
    terms = list(dict.fromkeys(terms_of(query, case_sensitive, min_length)))
    if not terms:
        return df.withColumn(score, F.lit(0.0)).where(F.lit(False))
    text = {f: F.col(f) if case_sensitive else F.lower(F.col(f)) for f in fields}
    # terms are found as substrings before anything is counted, so most rows cost one look
    found = df.where(_all([_any([text[f].contains(t) for f in fields]) for t in terms]))
    found = found.withColumns({f"__tokens_{i}": tokens(f, case_sensitive, min_length) for i, f in enumerate(fields)})
    points = {}
    for i, f in enumerate(fields):
        own = F.col(f"__tokens_{i}")
        for t in terms:
            exact = F.size(F.filter(own, _equal_to(t)))
            partial = F.size(F.filter(own, _with(t)))
            points[i, t] = F.when(exact > 0, 10.0 * exact).when(partial > 0, 5.0 * partial).when(text[f].contains(t), F.lit(2.0)).otherwise(F.lit(0.0))
    total = _sum(points.values())
    if "title" in fields:
        in_title = _sum([p for (i, _), p in points.items() if fields[i] == "title"])
        total = total * F.when(in_title > 0, F.lit(1.5)).otherwise(F.lit(1.0))
    return found.withColumn(score, total).drop(*[f"__tokens_{i}" for i in range(len(fields))])


def search(df: DataFrame, query: str, fields: list[str] | None = None, case_sensitive: bool = False, min_length: int = MIN_LENGTH, index: Index | None = None, score: str = "score") -> DataFrame:
    """By the index if there is one and case does not matter, else by a scan; without fields, those of the index or all string columns.

    The rows of ``df`` decide: an index names rows by id and only those in
    ``df`` are found.
    """
    if index is not None and not case_sensitive:
        return df.join(index.search(query, fields, score), index.id_field)
    return scan_search(df, query, fields or [c for c, t in df.dtypes if t == "string"], case_sensitive, min_length, score)


@dataclass(frozen=True)
class Index:
    """Postings as Parquet, sorted by token, so that a search reads the row groups of its terms only."""

    spark: SparkSession
    path: str
    id_field: str
    fields: tuple[str, ...]

    @classmethod
    def build(cls, df: DataFrame, id_field: str, fields: list[str], path: str) -> Index:
        """Writes the postings of all rows to ``path``."""
        every = postings(df, id_field, fields)
        every.repartitionByRange("token", id_field).sortWithinPartitions("token").write.mode("overwrite").parquet(path)
        return cls(df.sparkSession, path, id_field, tuple(fields))

    def search(self, query: str, fields: list[str] | None = None, score: str = "score") -> DataFrame:
        every = self.spark.read.parquet(self.path)
        return index_search(every.where(F.col("field").isin(*fields)) if fields else every, self.id_field, query, score)


def smart_index(df: DataFrame, id_field: str, fields: list[str], path: str, threshold: int = 1000) -> Index | None:
    """An index if there are at least ``threshold`` rows; a scan does for fewer."""
    return Index.build(df, id_field, fields, path) if df.count() >= threshold else None


def postings(df: DataFrame, id_field: str, fields: list[str]) -> DataFrame:
    """(id, field, token): the inverted index as a table; ``Index.build`` writes it for repeated use."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(tokens(f, numbers=False)).alias("tokens")) for f in fields])
    return df.select(id_field, F.explode(each).alias("e")).select(id_field, "e.field", F.explode("e.tokens").alias("token"))


def index_search(index: DataFrame, id_field: str, query: str, score: str = "score") -> DataFrame:
    """(id, score) from an inverted index: 10 a term and field, 5 more in ``title``, 3 more in ``description``, all terms needed, title matches half as much again."""
    terms = list(dict.fromkeys(terms_of(query, numbers=False)))
    hit = index.where(F.col("token").isin(*terms) if terms else F.lit(False))
    points = 10.0 + F.when(F.col("field") == "title", 5.0).when(F.col("field") == "description", 3.0).otherwise(0.0)
    # each term is a bit, so that one partial aggregate tells whether all are there
    bits = F.lit(0).cast("long")
    for k, term in enumerate(terms):
        bits = F.when(F.col("token") == term, F.lit(1 << k).cast("long")).otherwise(bits)
    grouped = hit.groupBy(id_field).agg(F.sum(points).alias("s"), F.bit_or(bits).alias("n"), F.max((F.col("field") == "title").cast("int")).alias("t"))
    return grouped.where(F.col("n") == (1 << len(terms)) - 1).select(id_field, (F.col("s") * F.when(F.col("t") == 1, 1.5).otherwise(1.0)).alias(score))


def stem(word: Column) -> Column:
    """The word in lower case without the first of SUFFIXES that leaves more than two letters."""
    word = F.lower(word)
    out = None
    for s in SUFFIXES:
        fits = word.endswith(s) & (F.char_length(word) > len(s) + 2)
        cut = F.left(word, F.char_length(word) - len(s))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(word)


def stem_word(word: str) -> str:
    word = word.lower()
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) > len(s) + 2), word)


def advanced_search(df: DataFrame, query: str, fields: list[str], stemming: bool = True, fuzzy: bool = False, max_distance: int = 2, phrases: bool = True, boosts: dict[str, float] | None = None, snippets: bool = False, score: str = "score") -> DataFrame:
    """Any term suffices: 1 for an equal (stemmed) word, else 0.5 for one within ``max_distance`` edits; a query in double quotes is a phrase, worth 10.

    Adds ``matched_terms`` and, with ``snippets``, a map ``highlights`` from field to excerpts.
    """
    boosts = boosts or {}
    query = query.strip()
    if phrases and len(query) >= 2 and query[0] == query[-1] == '"':
        phrase = query[1:-1].lower()
        hit = {f: F.coalesce(F.lower(F.col(f)).contains(phrase), F.lit(False)) for f in fields}
        total = _sum([F.when(hit[f], F.lit(10.0 * boosts.get(f, 1.0))).otherwise(0.0) for f in fields])
        out = df.withColumn("matched_terms", F.array(F.lit(query[1:-1])))
        excerpts = {f: F.when(hit[f], F.array(snippet(F.col(f), query[1:-1]))) for f in fields}
    else:
        terms = query.split()
        keys = [stem_word(t) if stemming else t for t in terms]
        found, points = {}, []
        for f in fields:
            words = F.split(F.coalesce(F.col(f), F.lit("")), r"\s+")
            words = F.transform(words, stem) if stemming else words
            for t, k in zip(terms, keys, strict=True):
                equal = F.array_contains(words, k)
                near = F.exists(words, _within(k, max_distance)) if fuzzy else F.lit(False)
                found[f, t] = F.col(f).isNotNull() & (equal | near)
                points.append(F.when(F.col(f).isNull(), 0.0).when(equal, boosts.get(f, 1.0)).when(near, 0.5 * boosts.get(f, 1.0)).otherwise(0.0))
        total = _sum(points) if points else F.lit(0.0)
        matched = F.array_compact(F.array(*[F.when(_any([found[f, t] for f in fields]), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")
        out = df.withColumn("matched_terms", matched)
        excerpts = {f: F.array_compact(F.array(*[F.when(found[f, t], snippet(F.col(f), t)) for t in terms])) for f in fields} if terms else {}
    if snippets and excerpts:
        out = out.withColumn("highlights", F.map_filter(F.create_map(*[x for f, e in excerpts.items() for x in (F.lit(f), e)]), lambda _, e: e.isNotNull() & (F.size(e) > 0)))
    return out.withColumn(score, total).where(F.col(score) > 0)


def snippet(text: Column, term: str, around: int = 50) -> Column:
    """The first match with ``around`` characters on both sides, dots where the text goes on; without a match, the beginning."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + len(term) - 1 + around, F.char_length(text))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.char_length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, around))


def highlight(text: Column, terms: list[str], tag: str = "mark") -> Column:
    """Whole-word matches between tags."""
    import re

    for t in terms:
        text = F.regexp_replace(text, rf"(?i)\b({re.escape(t)})\b", f"<{tag}>$1</{tag}>")
    return text


def _equal_to(term: str):
    return lambda w: w == term


def _with(term: str):
    return lambda w: w.contains(term)


def _within(key: str, most: int):
    return lambda w: F.levenshtein(w, F.lit(key)) <= most


def _sum(xs) -> Column:
    out = F.lit(0.0)
    for x in xs:
        out = out + x
    return out


def _any(xs) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | F.coalesce(x, F.lit(False))
    return out


def _all(xs) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x
    return out

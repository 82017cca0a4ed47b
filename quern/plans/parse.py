"""Queries as text and as JSON.

Text: ``[query] <field> <op> <value> [and ...] [sort <field> [asc|desc]] [limit n] [offset n] [--json|--ndjson]``.
"""

from __future__ import annotations

import json
import re
import shlex
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import predicates as P
from quern.operators.aggregates import Aggregate
from quern.query import Query


class ParseError(ValueError):
    pass


OPERATORS = {"=": P.equals, "==": P.equals, "eq": P.equals, "!=": P.not_equals, "<>": P.not_equals, "ne": P.not_equals, ">": P.greater, "gt": P.greater, "<": P.less, "lt": P.less, ">=": P.at_least, "gte": P.at_least, "<=": P.at_most, "lte": P.at_most, "contains": P.contains, "in": P.among}


@dataclass(frozen=True)
class TextQuery:
    filters: tuple[tuple[str, str, object], ...]
    sort: tuple[str, bool] | None = None
    limit: int | None = None
    offset: int | None = None
    output: str = "table"

    def query(self, df: DataFrame, policy: Column | None = None) -> Query:
        q = Query(df, policy)
        for field, op, value in self.filters:
            q = q.where(OPERATORS[op](field, value))
        if self.sort:
            q = q.order_by(self.sort[0], descending=self.sort[1])
        if self.offset is not None:
            q = q.offset(self.offset)
        return q if self.limit is None else q.limit(self.limit)


def literal(word: str):
    """null, bool, int, double, date and time, else text, whichever fits first."""
    low = word.lower()
    if low in ("null", "nil"):
        return None
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    if re.fullmatch(r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?", word):
        return datetime.fromisoformat(word)
    return word


def parse(text: str) -> TextQuery:
    lexer = shlex.shlex(text, posix=True, punctuation_chars="=!<>")
    lexer.whitespace_split = True
    lexer.commenters = ""
    try:
        words = list(lexer)
    except ValueError as e:
        raise ParseError(str(e)) from e
    if words and words[0].lower() == "query":
        words = words[1:]
    filters: list[tuple[str, str, object]] = []
    sort = limit = offset = None
    output, i = "table", 0
    while i < len(words):
        w = words[i].lower()
        if w in ("--json", "--ndjson", "--raw"):
            output, i = w[2:], i + 1
        elif w == "sort" and i + 1 < len(words):
            down = i + 2 < len(words) and words[i + 2].lower() in ("asc", "desc")
            sort = (words[i + 1], down and words[i + 2].lower() == "desc")
            i += 3 if down else 2
        elif w in ("limit", "offset"):
            if i + 1 >= len(words) or not words[i + 1].isdigit():
                raise ParseError(f"{w} needs a number")
            limit, offset = (int(words[i + 1]), offset) if w == "limit" else (limit, int(words[i + 1]))
            i += 2
        else:
            if filters:
                if w != "and":
                    raise ParseError(f"unexpected: {words[i]}")
                i += 1
            if i + 2 >= len(words) or words[i + 1].lower() not in OPERATORS or words[i + 1].lower() == "in":
                raise ParseError("a filter is <field> <op> <value>")
            op = words[i + 1].lower()
            value = words[i + 2] if op == "contains" else literal(words[i + 2])
            filters.append((words[i], op, value))
            i += 3
    if not filters:
        raise ParseError("a query needs a filter")
    return TextQuery(tuple(filters), sort, limit, offset, output)


def condition(f: dict) -> Column:
    """{field, op, value}; op is eq, ne, gt, gte, lt, lte, contains, in, nil or notNil."""
    op = f.get("op", "eq")
    if op == "nil":
        return P.missing(f["field"])
    if op == "notNil":
        return P.present(f["field"])
    if op not in OPERATORS:
        raise ParseError(f"no such op: {op}")
    value = f.get("value")
    if isinstance(value, str) and op not in ("contains", "in"):
        value = literal(value) if re.fullmatch(r"\d{4}-\d\d-\d\d[T ].*", value) else value
    return OPERATORS[op](f["field"], value)


def from_json(df: DataFrame, request: dict | str, policy: Column | None = None) -> Query:
    """{filters, sort: [{field, descending}], limit, offset, groupBy, aggregations: [{type, field, alias}], project}."""
    r = json.loads(request) if isinstance(request, str) else request
    q = Query(df, policy)
    for f in r.get("filters") or r.get("filter") or []:
        q = q.where(condition(f))
    if r.get("groupBy"):
        q = q.group_by(*([r["groupBy"]] if isinstance(r["groupBy"], str) else r["groupBy"]))
    for a in r.get("aggregations") or []:
        q = q._aggregate(Aggregate(a["type"], a.get("field"), a.get("alias")))
    for s in r.get("sort") or []:
        q = q.order_by(s["field"], descending=bool(s.get("descending")))
    if r.get("offset") is not None:
        q = q.offset(int(r["offset"]))
    if r.get("limit") is not None:
        q = q.limit(int(r["limit"]))
    return q.project(*r["project"]) if r.get("project") else q


def lines(df: DataFrame, output: str = "table") -> DataFrame:
    """A column ``line`` with each row as a table line or as JSON."""
    if output == "table":
        return df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("line"))
    return df.select(F.to_json(F.struct("*")).alias("line"))


def shown(df: DataFrame, output: str = "table", most: int | None = None) -> str:
    """All rows (or the first ``most``) as a table, a JSON array or JSON lines: what a shell prints.

    Rows are fetched partition by partition; the text is the caller's to hold.
    """
    rows = [r[0] for r in lines(df if most is None else df.limit(most), output).toLocalIterator()]
    if output == "table":
        return "\n".join(["\t".join(df.columns), *rows])
    return "\n".join(rows) if output == "ndjson" else "[" + ",".join(rows) + "]"

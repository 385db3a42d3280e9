"""Parsers of model answers: triples, entities, relation definitions.

Brackets nest, which no regular expression follows, so triples and entities are parsed in Python on Arrow batches; definitions are plain SQL.
"""

from __future__ import annotations

import ast
import re
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.functions.text import strip

#: Python itself reads no literal whose brackets nest deeper.
DEEPEST = 200

TRIPLES = T.StructType([T.StructField("triples", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("rejects", T.ArrayType(T.StringType()))])


_ITEM = r"""(?:'[^'\\\n\r\0]*'|"[^"\\\n\r\0]*")"""
_PLAIN = rf"\[[ \n]*{_ITEM}(?:[ \n]*,[ \n]*{_ITEM})*[ \n]*\]"
_ONE = re.compile(_PLAIN).fullmatch
_MANY = re.compile(rf"\[[ \n]*{_PLAIN}(?:[ \n]*,[ \n]*{_PLAIN})*[ \n]*\]").fullmatch
_ITEMS = re.compile(_ITEM).findall


def bracketed(text: str) -> list[str]:
    """The bracketed parts of a text in order of their closing brackets; quotes are not looked at, brackets without a partner are skipped."""
    opened: list[list[int]] = []
    out = []
    for i, c in enumerate(text):
        if c == "[":
            opened.append([i, 1])
        elif c == "]" and opened:
            start, height = opened.pop()
            if opened:
                opened[-1][1] = max(opened[-1][1], height + 1)
            if height < DEEPEST:
                out.append(text[start : i + 1])
    return out


def literal(text: str):
    """The Python literal that text is, or None."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)  # odd escapes are what the text has
            return ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def raw_triples(text: str | None) -> list[list]:
    """The triples in an answer as they were written; elements may be of any type and lists of any length.

    A list of three strings counts unless one is empty or a lone underscore. A list whose elements are not all of the first one's type counts
    whatever its length, with inner lists of strings joined by comma. Everything else, a well-formed outer list included, is dropped.
    """
    out = []
    for part in bracketed(text or ""):
        if _MANY(part):  # a list of lists of strings, as well-formed answers are, without reading it as a literal
            continue
        value = [x[1:-1] for x in _ITEMS(part)] if _ONE(part) else literal(part)
        if not isinstance(value, list) or not value:
            continue
        if len(value) == 3 and all(type(x) is str for x in value):
            if not {"", "_"} & set(value):
                out.append(value)
        elif any(type(x) is not type(value[0]) for x in value):
            try:
                out.append([", ".join(x) if type(x) is list else x for x in value])
            except TypeError:
                continue
    return out


def split_triples(text: str | None, strict_arity: bool = True) -> tuple[list[list[str]], list[str]]:
    """(triples of strings, rejects): scalars become strings; a null element or, if strict_arity, another length than three is a reject."""
    good, bad = [], []
    for t in raw_triples(text):
        if any(x is None for x in t) or (strict_arity and len(t) != 3):
            bad.append(repr(t))
        else:
            good.append([x if type(x) is str else str(x) for x in t])
    return good, bad


def parsed_triples(answer: Column, strict_arity: bool = True) -> Column:
    """A struct of ``triples`` and ``rejects`` from an answer; null or empty gives empty arrays."""

    @F.pandas_udf(TRIPLES)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [split_triples(t, strict_arity) for t in texts]
        return pd.DataFrame({"triples": [r[0] for r in rows], "rejects": [r[1] for r in rows]})

    return run(answer)


def entities(text: str | None) -> list[str]:
    """The list from the first opening to the last closing bracket of an answer, elements as strings, nulls left out; [] if it is no list."""
    a, b = (text or "").find("["), (text or "").rfind("]")
    value = literal(text[a : b + 1]) if 0 <= a < b else None
    return [x if type(x) is str else str(x) for x in value if x is not None] if isinstance(value, list) else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def parsed_entities(answers: pd.Series) -> pd.Series:
    return answers.map(entities)


def definition_lines(df: DataFrame, answer: str, keys: list[str]) -> DataFrame:
    """(keys, line_no, relation, definition): every line of an answer with a colon, cut at the first one; the key ``Answer`` is skipped."""
    lines = df.select(*keys, F.posexplode(F.split(answer, "\n")).alias("line_no", "line")).where(F.contains("line", F.lit(":")))
    at = F.instr("line", ":")
    cut = lines.select(*keys, "line_no", strip(F.expr("substring(line, 1, instr(line, ':') - 1)")).alias("relation"), strip(F.col("line").substr(at + 1, F.length("line"))).alias("definition"))
    return cut.where("relation <> 'Answer'")


def definitions(df: DataFrame, answer: str, keys: list[str]) -> DataFrame:
    """(keys, relation, definition): one row for each relation of an answer; the last line wins. Null answers give no rows."""
    return definition_lines(df, answer, keys).groupBy(*keys, "relation").agg(F.max_by("definition", "line_no").alias("definition"))

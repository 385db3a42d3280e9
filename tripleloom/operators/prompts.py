"""Prompts as column expressions.

A template is cut into literal and field parts once, on the driver; a row's prompt is their concatenation. So a value that looks like a
placeholder stays as it is.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleloom.functions.text import listed


def fill(template: str, **values: Column) -> Column:
    """The template with ``{name}`` replaced by each row's value; null prints as nothing. Doubled braces are braces.

    An unknown placeholder raises KeyError; values without a placeholder are ignored.
    """
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def fill_constant(template: str, **values: str) -> str:
    """The template with constant values, filled on the driver."""
    return template.format_map(values)


def choices(candidates: Column) -> Column:
    """The choices of a verifier prompt from an array of (relation, definition, ...): a letter each from A, and one for none of them."""
    lines = F.transform(candidates, lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". '"), c["relation"], F.lit("': "), F.coalesce(c["definition"], F.lit("")), F.lit("\n")))
    return F.concat(F.array_join(lines, ""), F.char(F.lit(65) + F.size(candidates)), F.lit(". None of the above.\n"))


def chosen(answer: Column, candidates: Column, mode: str = "exact") -> Column:
    """The candidate that a verifier's answer names by letter, else null.

    ``exact`` takes the answer as a whole, ``first_char`` its first character. An empty or null answer, a letter beyond the candidates and
    the letter of "none" give null.
    """
    letter = answer if mode == "exact" else F.substring(answer, 1, 1)
    at = F.when(F.length(letter) == 1, F.ascii(letter) - 64)
    return F.when((at >= 1) & (at <= F.size(candidates)), F.try_element_at(candidates, at))


def hint_line(number: Column, relation: Column, definition: Column, text: Column | None = None, triplet: Column | None = None) -> Column:
    """A line of a relation hint, with an example where there is one."""
    line = F.concat(number.cast("string"), F.lit(". "), relation, F.lit(": "), F.coalesce(definition, F.lit("")), F.lit("\n"))
    if triplet is None:
        return line
    example = F.concat(F.lit("For example, "), listed(triplet), F.lit(' can be extracted from "'), F.coalesce(text, F.lit("")), F.lit('"\n'))
    return F.concat(line, F.coalesce(example, F.lit("")))


def messages(system: Column, user: Column) -> Column:
    """Chat messages: the instructions as system, the input as user."""
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))

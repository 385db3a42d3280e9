"""Words, cores and other text functions, as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every kind, zero-width space, and Unicode punctuation.
SEPARATORS = r"[\s\x0B\x1C-\x1F\x85\u200B\p{Z}\p{P}]+"
#: Fixed value: a word is a longest run of letters and digits.
WORD = r"[\p{L}\p{N}]+"
#: The white space that a Unicode strip takes off, at either end.
EDGES = r"^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$"


def core(c: Column) -> Column:
    """What is left of a string in lower case without white space and punctuation; null stays null."""
    return F.lower(F.regexp_replace(c, SEPARATORS, ""))


def words(c: Column) -> Column:
    """The words of a string in lower case, in order, repeats kept; null gives null, a text without words an empty array."""
    return F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lower)


def strip(c: Column) -> Column:
    """The string without Unicode white space at its ends."""
    return F.regexp_replace(c, EDGES, "")


def whole_triplet(c: Column) -> Column:
    """Whether an array of strings has exactly three elements, none null and none with an empty core; null gives false."""
    return F.coalesce((F.size(c) == 3) & F.forall(c, lambda x: F.coalesce(core(x) != "", F.lit(False))), F.lit(False))


def quoted(c: Column) -> Column:
    """A string as a Python literal: single quotes unless the text has a single and no double quote.

    Backslash, tab, line feed and carriage return are escaped; other control characters stay as they are.
    """
    body = c
    for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        body = F.replace(body, F.lit(plain), F.lit(escaped))
    one, two = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return F.when(one & ~two, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def listed(c: Column) -> Column:
    """An array of strings as a Python list literal; a null element prints None."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(quoted(x), F.lit("None"))), ", "), F.lit("]"))


def listed_lists(c: Column) -> Column:
    """An array of arrays of strings as a Python list literal."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(listed(x), F.lit("None"))), ", "), F.lit("]"))


def listed_set(c: Column) -> Column:
    """An array of strings as a Python set literal, in the array's order; an empty one prints set()."""
    inner = F.array_join(F.transform(c, lambda x: F.coalesce(quoted(x), F.lit("None"))), ", ")
    return F.when(F.size(c) == 0, F.lit("set()")).otherwise(F.concat(F.lit("{"), inner, F.lit("}")))

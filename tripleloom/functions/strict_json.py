"""JSON by the strict standard, for use inside Python workers."""

from __future__ import annotations

import json
import re

_SPACE = " \t\n\r"
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


class Pairs(list):
    """The members of an object in order, repeated keys kept."""


class Number(str):
    """A number as it was written."""


def _no(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(object_pairs_hook=Pairs, parse_float=Number, parse_int=Number, parse_constant=_no, strict=True)


def _deep(text: str) -> bool:
    """Whether text is one JSON value, without recursion: for values nested too deeply for the decoder."""
    at, stack, want = 0, [], "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            return want == "end" and not text[at:].strip(_SPACE)
        at, mark = m.end(), m.group(1)
        if want == "end":
            return False
        if want in ("value", "first") and (m.group(2) or m.group(3)):
            want = stack[-1] if stack else "end"
        elif want in ("value", "first") and mark in ("{", "["):
            stack.append("more}" if mark == "{" else "more]")
            want = "key1" if mark == "{" else "first"
        elif (want == "first" and mark == "]") or (want == "key1" and mark == "}") or (want == "more" + (mark or "?") and mark in ("}", "]")):
            stack.pop()
            want = stack[-1] if stack else "end"
        elif want in ("key1", "key") and m.group(2):
            want = "colon"
        elif want == "colon" and mark == ":":
            want = "value"
        elif want == "more}" and mark == ",":
            want = "key"
        elif want == "more]" and mark == ",":
            want = "value"
        else:
            return False


def parse(text: str):
    """(True, value) if text is exactly one JSON value with blanks around it, else (False, None).

    Objects come as Pairs, numbers as Number. A valid value nested too deeply to be built comes as (True, None).
    """
    try:
        return True, _DECODER.decode(text)
    except RecursionError:
        return _deep(text), None
    except ValueError:
        return False, None


def summarization(text: str | None) -> str | None:
    """The text under the key ``summarization`` of a JSON object that has it once, as a string; else None."""
    if text is None:
        return None
    ok, value = parse(text)
    if not ok or not isinstance(value, Pairs):
        return None
    found = [v for k, v in value if k == "summarization"]
    return found[0] if len(found) == 1 and type(found[0]) is str else None


def reason(line: str) -> tuple[str | None, int | None, str | None]:
    """(None, iid, summary) of a valid profile line, else (reason, None, None); the first reason that holds."""
    ok, value = parse(line)
    if not ok:
        return "bad_json", None, None
    if not isinstance(value, Pairs) or sorted(k for k, _ in value) != ["business summary", "iid"]:
        return "wrong_fields", None, None
    fields = dict(value)
    iid = fields["iid"]
    if not isinstance(iid, Number) or not re.fullmatch(r"[0-9]{1,19}", iid) or int(iid) >= 2**63:
        return "bad_iid", None, None
    inner = fields["business summary"]
    text = summarization(inner) if type(inner) is str else None
    if text is None or all(c.isspace() or c == "\u200b" for c in text):
        return "bad_summary", None, None
    return None, int(iid), text

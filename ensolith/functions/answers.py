"""JSON out of free text: found, mended and closed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_CLOSING = {"{": "}", "[": "]"}
_PLAIN = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _ends_string(text: str, at: int) -> bool:
    """Whether the quote at a place ends its string: what follows can only follow a string."""
    rest = text[at + 1 :].lstrip()
    if not rest or rest[0] in ":}]":
        return True
    if rest[0] == ",":  # a comma goes on to a value or a key; in prose it goes on to a word
        after = rest[1:].lstrip()
        return not after or after[0] in '"{[]}-' or after[0].isdigit() or after.startswith(("true", "false", "null"))
    return False


def mended(text: str) -> str | None:
    """The first object or list of a text as valid JSON, if what is wrong with it can be mended.

    One pass with a stack: breaks inside strings and stray quotes are escaped, commas before a closing
    bracket go, brackets and strings that never close are closed, and what hangs unfinished at the end (a
    key without its value) goes.
    """
    start = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
    if start < 0:
        return None
    out: list[str] = []
    stack: list[str] = []
    inside, escaped = False, False
    for at in range(start, len(text)):
        c = text[at]
        if inside:
            if escaped:
                escaped = False
                out.append(c)
            elif c == "\\":
                escaped = True
                out.append(c)
            elif c == '"' and _ends_string(text, at):
                inside = False
                out.append(c)
            else:
                out.append('\\"' if c == '"' else _PLAIN.get(c, c))
            continue
        if c == '"':
            inside = True
        elif c in _CLOSING:
            stack.append(_CLOSING[c])
        elif c in "]}":
            if not stack or stack[-1] != c:
                return None
            _without_comma(out)
            stack.pop()
        out.append(c)
        if not stack:
            return "".join(out)
    if escaped:
        out.pop()
    if inside:
        out.append('"')
    return _closed("".join(out), stack)


def _without_comma(out: list[str]) -> None:
    while out and (out[-1].isspace() or out[-1] == ","):
        out.pop()


def _closed(open_: str, stack: list[str]) -> str | None:
    """A cut-off text with its brackets closed, less what is unfinished at its end."""
    ends = "".join(reversed(stack))
    while open_:
        tail = open_.rstrip().rstrip(",")
        try:
            json.loads(tail + ends)
            return tail + ends
        except ValueError:
            cut = max(tail.rfind(","), tail.rfind("{") + 1, tail.rfind("[") + 1)
            if cut <= 0 or cut >= len(open_):
                return None
            open_ = tail[:cut]
            if open_.count("{") + open_.count("[") < len(stack):
                return None
    return None


def extracted(text: str | None) -> str | None:
    """The JSON value of a text, written plainly; null if there is none that can be mended."""
    if text is None:
        return None
    body = text
    if "```" in text:
        body = text.split("```")[1]
        body = body[4:] if body.startswith("json") else body
    for part in (body, text):
        at = min((k for k in (part.find("{"), part.find("[")) if k >= 0), default=-1)
        if at < 0:
            continue
        try:
            return json.dumps(json.JSONDecoder().raw_decode(part[at:])[0], ensure_ascii=False)
        except ValueError:
            pass
        fixed = mended(part)
        if fixed is not None:
            try:
                return json.dumps(json.loads(fixed), ensure_ascii=False)
            except ValueError:
                pass
    return None


@F.pandas_udf(StringType())
def _extracted(texts: pd.Series) -> pd.Series:
    return texts.map(extracted)


def extract_json(text: Column) -> Column:
    """The first JSON object or list in free text, valid and plainly written; read it with from_json."""
    return _extracted(text)

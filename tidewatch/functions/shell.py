"""Shell lines taken apart: segments, tokens, and the shape that stays when values are replaced.

Quoting has no SQL counterpart, so these are Arrow-batched UDFs.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("||", "&&", ";", "|", "&", "\n")
_COMMAND = re.compile(r"[a-z][a-z0-9_.+-]{0,63}")
_CLASSES = [
    ("ENV", re.compile(r"[A-Za-z_]\w*=.*", re.S)),
    ("URL", re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://.*", re.S)),
    ("IP", re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?")),
    ("IP6", re.compile(r"(?=(?:[^:]*:){2})[0-9a-fA-F:]+")),
    ("PATH", re.compile(r"(?:/|\./|\.\./|~/|~$).*", re.S)),
    ("INT", re.compile(r"\d+")),
    ("HEX", re.compile(r"[0-9a-fA-F]{8,}")),
]


def split_tokens(line: str) -> list[list[str]]:
    """Segments of tokens; quotes keep blanks and operators inside a token, an open quote ends with the line."""
    segments: list[list[str]] = [[]]
    token, quote, started, i = "", "", False, 0
    while i < len(line):
        c = line[i]
        if quote:
            if c == quote:
                quote = ""
            elif c == "\\" and quote == '"' and i + 1 < len(line):
                i += 1
                token += line[i]
            else:
                token += c
        elif c in "\"'":
            quote, started = c, True
        elif c == "\\" and i + 1 < len(line):
            i += 1
            token += line[i]
            started = True
        else:
            op = next((o for o in OPERATORS if line.startswith(o, i)), None)
            if op or c.isspace():
                if token or started:
                    segments[-1].append(token)
                token, started = "", False
                if op:
                    segments.append([])
                    i += len(op) - 1
            else:
                token += c
        i += 1
    if token or started:
        segments[-1].append(token)
    return [s for s in segments if s]


def value_class(token: str) -> str:
    """The placeholder a value is replaced with; the first class that fits."""
    for name, pattern in _CLASSES:
        if pattern.fullmatch(token):
            return name
    if re.fullmatch(r"[A-Za-z0-9+/=]{16,}", token):
        kinds = sum(any(f(c) for c in token) for f in (str.isupper, str.islower, str.isdigit))
        if kinds >= 2:
            return "B64"
    return "ARG"


def command_name(token: str) -> str | None:
    """Base name in lower case without leading dots; None if it can't be a command."""
    name = token.rsplit("/", 1)[-1].lower().lstrip(".")
    return name if _COMMAND.fullmatch(name) else None


def shape(line: str) -> str:
    """Commands, flags and separators of a line with values replaced; empty if no segment starts with a command."""
    out = []
    for seg in split_tokens(line):
        at = next((i for i, t in enumerate(seg) if not re.fullmatch(r"[A-Za-z_]\w*=.*", t, re.S)), None)
        name = command_name(seg[at]) if at is not None else None
        if not name:
            continue
        rest = seg[at + 1 :]
        words = ["ENV"] * at + [name]
        if name == "busybox" and rest and (applet := command_name(rest[0])):
            words.append(applet)
            rest = rest[1:]
        out.append(" ".join([*words, *(t if t.startswith("-") and len(t) <= 24 and "=" not in t else value_class(t) for t in rest)]))
    return " ; ".join(out)


def segments(line: str) -> list[dict]:
    """(command, flags) of every segment that starts with a command."""
    out = []
    for seg in split_tokens(line):
        name = command_name(seg[0])
        if name:
            out.append({"command": name, "flags": [t for t in seg[1:] if t.startswith("-")]})
    return out


def shape_column(line: Column) -> Column:
    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda s: None if s is None else shape(s))

    return run(line)


def segments_column(line: Column) -> Column:
    @F.udf("array<struct<command:string,flags:array<string>>>", useArrow=True)
    def run(s):  # noqa: ANN001, ANN202
        return None if s is None else segments(s)

    return run(line)

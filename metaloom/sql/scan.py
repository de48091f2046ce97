"""Splitting of SQL text into code, literals and comments, on the driver."""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"""(?sx)
      (?P<comment> --[^\n]* | /\*.*?(?:\*/|\Z) )
    | (?P<string> '(?:[^']|'')*' )
    | (?P<ident> "(?:[^"]|"")*" | `(?:[^`]|``)*` )
    | (?P<number> \b\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\b )
    | (?P<word> [A-Za-z_][\w$]* )
    | (?P<space> \s+ )
    | (?P<op> ::|<>|!=|<=|>=|\|\||=>|->>|->|. )
    """
)


def tokens(sql: str) -> list[tuple[str, str]]:
    """(kind, text) of every token but white space and comments."""
    return [(m.lastgroup, m.group()) for m in TOKEN.finditer(sql) if m.lastgroup not in ("space", "comment")]


def mask_literals(sql: str) -> str:
    """The statement with literals as ?, without comments, white space collapsed."""
    out = ["?" if kind in ("string", "number") else text for kind, text in tokens(sql)]
    return " ".join(out)


def statements(sql: str) -> list[str]:
    """The statements between semicolons outside literals; empty ones don't count."""
    out, part = [], []
    for m in TOKEN.finditer(sql):
        if m.group() == ";":
            out.append("".join(part))
            part = []
        elif m.lastgroup != "comment":
            part.append(m.group())
    out.append("".join(part))
    return [s.strip() for s in out if s.strip()]

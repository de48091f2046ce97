"""Comparing the structure of two statements."""

from __future__ import annotations

from metaloom.sql.scan import tokens

#: Clauses that end another.
CLAUSES = ("with", "select", "from", "where", "group", "having", "order", "limit", "offset", "qualify", "window", "union", "intersect", "except")
JOIN_WORDS = {"inner", "left", "right", "full", "cross", "semi", "anti", "outer", "asof", "lateral", "natural", "straight_join", "apply"}


def _split(items: list[str], by: str) -> list[str]:
    out, part, depth = [], [], 0
    for t in items:
        depth += (t == "(") - (t == ")")
        if t == by and depth == 0:
            out.append(" ".join(part))
            part = []
        else:
            part.append(t)
    return [x for x in [*out, " ".join(part)] if x]


def _joined_between(items: list[str]) -> list[str]:
    """The AND that belongs to a BETWEEN, at its own depth, is no link between filters; it is written ``to`` here."""
    out, open_, depth = [], [], 0
    for t in items:
        depth += (t == "(") - (t == ")")
        if t == "between":
            open_.append(depth)
        elif t == "and" and open_ and open_[-1] == depth:
            open_.pop()
            t = "to"
        out.append(t)
    return out


def signature(sql: str) -> dict[str, list[str]]:
    """Tables, joins, selected expressions, filters as conjuncts, and grouping of the outermost SELECT, in lower case, sorted."""
    items = [t.lower() if k == "word" else t.strip("`\"").lower() if k == "ident" else t for k, t in tokens(sql)]
    parts: dict[str, list[str]] = {}
    clause, depth = "", 0
    for t in items:
        depth += (t == "(") - (t == ")")
        if depth == 0 and t in CLAUSES:
            clause = t
            parts.setdefault(clause, [])
            continue
        parts.setdefault(clause, []).append(t)
    tables, joins, source = [], [], parts.get("from", [])
    kind: list[str] = []
    expect, level = True, 0
    i = 0
    while i < len(source):
        t = source[i]
        level += (t == "(") - (t == ")")
        if t in JOIN_WORDS:
            kind.append(t)
        elif t == "join":
            joins.append(" ".join([w for w in kind if w not in ("outer", "inner")] or ["inner"]))
            kind, expect = [], True
        elif t == "," and level == 0:
            joins.append("cross")
            expect = True
        elif expect and level == 0:
            name = t
            while i + 2 < len(source) and source[i + 1] == ".":
                name += "." + source[i + 2]
                i += 2
            tables.append(name)
            expect = False
        i += 1
    where = _split(_joined_between(parts.get("where", [])), "and")
    group = parts.get("group", [])
    return {
        "tables": sorted(tables), "joins": sorted(joins), "select": sorted(_split(parts.get("select", []), ",")), "filters": sorted(where),
        "group_by": sorted(_split(group[1:] if group[:1] == ["by"] else group, ",")),
    }


def diff(a: str, b: str) -> dict[str, dict[str, list[str]]]:
    """For each part of the signature what only the first, only the second, and both have."""
    x, y = signature(a), signature(b)
    return {k: {"only_first": sorted(set(x[k]) - set(y[k])), "only_second": sorted(set(y[k]) - set(x[k])), "both": sorted(set(x[k]) & set(y[k]))} for k in x}


def alias_pairs(sql: str) -> list[tuple[str, str]]:
    """(column, alias) of each ``column AS alias`` in a select list, qualifiers dropped, in lower case, without repeats."""
    items = [(k, t.lower() if k == "word" else t.strip('`"').lower() if k == "ident" else t) for k, t in tokens(sql)]
    out = []
    for i in range(1, len(items) - 1):
        if items[i] == ("word", "as") and items[i - 1][0] in ("word", "ident") and items[i + 1][0] in ("word", "ident") and items[i + 1][1] not in CLAUSES:
            start = items[i - 2][1] if i > 1 else ""
            first = items[i - 4][1] if start == "." and i > 3 else start
            if first in (",", "select", "distinct"):
                out.append((items[i - 1][1], items[i + 1][1]))
    return list(dict.fromkeys(out))

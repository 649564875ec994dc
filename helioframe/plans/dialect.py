"""PostgreSQL text that Spark reads otherwise, rewritten: matches by regular expression, DISTINCT ON, generate_series, the
first rows of LATERAL subqueries."""

from __future__ import annotations

import re

from helioframe.plans.text import split_list

_PART = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|!?~~?\*?|\w+|[()]|\s+|.", re.S)
#: What each operator becomes: its word, and whether case counts.
_MATCH = {"~": ("RLIKE", True), "!~": ("NOT RLIKE", True), "~*": ("RLIKE", False), "!~*": ("NOT RLIKE", False), "~~": ("LIKE", True), "!~~": ("NOT LIKE", True), "~~*": ("ILIKE", True), "!~~*": ("NOT ILIKE", True)}
#: Words after which ~ is a sign before a number, not an operator between two values.
_BEFORE = frozenset("SELECT WHERE AND OR NOT ON HAVING WHEN THEN ELSE CASE BY IN LIKE BETWEEN DISTINCT ALL RETURN".split())


def _parts(text: str) -> list[str]:
    return _PART.findall(text)


def _close(parts: list[str], at: int) -> int:
    """The place of the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(parts)):
        depth += {"(": 1, ")": -1}.get(parts[i], 0)
        if not depth:
            return i
    raise ValueError("a bracket is not closed")


def _next(parts: list[str], at: int) -> int:
    while at < len(parts) and parts[at].isspace():
        at += 1
    return at


def _matches(parts: list[str]) -> list[str]:
    out: list[str] = []
    for i, p in enumerate(parts):
        last = next((x for x in reversed(out) if not x.isspace()), "")
        if p not in _MATCH or not (last[-1:] in ")'\"`" or (last[-1:].isalnum() or last[-1:] == "_") and last.upper() not in _BEFORE):
            out.append(p)
            continue
        word, exact = _MATCH[p]
        out.append(f" {word} " if exact else f" {word} '(?i)' || ")
    return out


def _series(parts: list[str]) -> list[str]:
    """generate_series(a, b) and (a, b, step) as an exploded sequence; without a step, nothing if a is beyond b."""
    out, i = [], 0
    while i < len(parts):
        after = _next(parts, i + 1)
        if parts[i].lower() != "generate_series" or parts[after : after + 1] != ["("]:
            out.append(parts[i])
            i += 1
            continue
        end = _close(parts, after)
        items = split_list("".join(_series(parts[after + 1 : end])))
        if len(items) == 2:
            a, b = items
            out.append(f"explode(IF({a} <= {b}, sequence({a}, greatest({a}, {b})), slice(sequence({a}, {a}), 1, 0)))")
        else:
            out.append(f"explode(sequence({', '.join(items)}))")
        i = end + 1
    return out


def _distinct_on(parts: list[str]) -> str:
    """SELECT DISTINCT ON (keys) list FROM ... ORDER BY ... : the first row of each key, by row_number."""
    words = [(i, p.upper()) for i, p in enumerate(parts) if not p.isspace()]
    if [w for _, w in words[:3]] != ["SELECT", "DISTINCT", "ON"]:
        return "".join(parts)
    start = words[3][0]
    end = _close(parts, start)
    keys = "".join(parts[start + 1 : end])
    depth, marks = 0, {}
    for i in range(end + 1, len(parts)):
        depth += {"(": 1, ")": -1}.get(parts[i], 0)
        word = parts[i].upper()
        if not depth and word in ("FROM", "LIMIT", "OFFSET") and word not in marks:
            marks[word] = i
        if not depth and word == "ORDER" and parts[_next(parts, i + 1)].upper() == "BY":
            marks["ORDER"] = i
    if "FROM" not in marks:
        raise ValueError("DISTINCT ON needs a FROM")
    tail = min([marks[w] for w in ("LIMIT", "OFFSET") if w in marks] or [len(parts)])
    order = "".join(parts[_next(parts, marks["ORDER"] + 1) + 1 : tail]) if "ORDER" in marks else ""
    items = split_list("".join(parts[end + 1 : marks["FROM"]]))
    rest = "".join(parts[marks["FROM"] : marks.get("ORDER", tail)])
    by = [re.match(r"(?is)(.+?)((?:\s+(?:ASC|DESC))?(?:\s+NULLS\s+(?:FIRST|LAST))?)$", x).groups() for x in split_list(order)]
    by = [(e, way if "NULLS" in way.upper() else f"{way} NULLS {'FIRST' if 'DESC' in way.upper() else 'LAST'}") for e, way in by]
    hidden = [f"{e} AS `__by{i}`" for i, (e, _) in enumerate(by)]
    within = ", ".join(f"{e}{way}" for e, way in by) or "NULL"
    inner = f"SELECT {', '.join([*items, *hidden])}, row_number() OVER (PARTITION BY {keys} ORDER BY {within}) AS `__nth` {rest}"
    drop = ", ".join([*[f"`__by{i}`" for i in range(len(by))], "`__nth`"])
    out = f"SELECT * EXCEPT ({drop}) FROM ({inner}) WHERE `__nth` = 1"
    if by:
        out += " ORDER BY " + ", ".join(f"`__by{i}`{way}" for i, (_, way) in enumerate(by))
    return f"{out} {''.join(parts[tail:])}".strip()


def _lateral(parts: list[str]) -> list[str]:
    """LATERAL (SELECT ... ORDER BY ... LIMIT n): the first rows of each outer row, by row_number.

    Spark sorts below the exchange that brings an outer row's rows together, and numbers them there as they arrive.
    Text stays in its order, so that marks without names still meet their values.
    """
    out, i = [], 0
    while i < len(parts):
        after = _next(parts, i + 1)
        out.append(parts[i])
        if parts[i].upper() == "LATERAL" and parts[after : after + 1] == ["("]:
            end = _close(parts, after)
            out += [" ", "(", _first_rows(_lateral(parts[after + 1 : end])), ")"]
            i = end
        i += 1
    return out


def _first_rows(parts: list[str]) -> str:
    """A query with ORDER BY and LIMIT as one that numbers its rows in that order."""
    depth, marks, set_of_rows = 0, {}, False
    for i, p in enumerate(parts):
        depth += {"(": 1, ")": -1}.get(p, 0)
        word = p.upper()
        if depth or p.isspace():
            continue
        if word in ("SELECT", "FROM", "WINDOW", "LIMIT", "OFFSET") or word == "ORDER" and parts[_next(parts, i + 1)].upper() == "BY":
            marks.setdefault(word, i)
        set_of_rows |= word in ("DISTINCT", "UNION", "INTERSECT", "EXCEPT", "MINUS", "GROUP") or word == "SELECT" and marks["SELECT"] != _next(parts, 0)
    tail = marks.get("LIMIT", len(parts))
    most = "".join(parts[tail + 1 : marks.get("OFFSET", len(parts))]).strip()
    if not {"SELECT", "FROM", "ORDER", "LIMIT"} <= set(marks) or most.upper() == "ALL":
        return "".join(parts)
    order = _next(parts, marks["ORDER"] + 1) + 1
    keys, names = split_list("".join(parts[order:tail])), {}
    body = "".join(parts[: marks["ORDER"]])
    if not set_of_rows:  # a name or a place in the list stands for what it names
        items = split_list("".join(parts[marks["SELECT"] + 1 : marks["FROM"]]))
        for n, x in enumerate(items, 1):
            if not any("*" == y.split(".")[-1].strip() for y in items[:n]):
                names[str(n)] = re.sub(r"(?is)\s+AS\s+\S+$", "", x)
            if m := re.fullmatch(r"(?is)(.+?)\s+AS\s+`?(\w+)`?", x):
                names[m[2].lower()] = m[1]
    by = []
    for k in keys:
        e, way = re.match(r"(?is)(.+?)((?:\s+(?:ASC|DESC))?(?:\s+NULLS\s+(?:FIRST|LAST))?)$", k).groups()
        meant = names.get(e.strip("`").lower(), e)
        if meant.isdigit() or meant != e and "?" in meant:
            raise ValueError(f"ORDER BY {k} in LATERAL: give the expression or a column's name")
        by.append(meant + way)
    window = f"`__by` AS (ORDER BY {', '.join(by)})"
    nth = "row_number() OVER `__by` AS `__nth`"
    if set_of_rows:
        inner = f"SELECT *, {nth} FROM ({body}) WINDOW {window}"
    else:
        inner = f"{''.join(parts[: marks['FROM']])}, {nth} {''.join(parts[marks['FROM'] : marks['ORDER']])}{',' if 'WINDOW' in marks else 'WINDOW'} {window}"
    kept = f"`__nth` <= {most}"
    if "OFFSET" in marks:
        kept = f"transform(array(struct({most} AS most, {''.join(parts[marks['OFFSET'] + 1 :])} AS past)), x -> `__nth` > x.past AND `__nth` <= x.past + x.most)[0]"
    return f"SELECT * EXCEPT (`__nth`) FROM ({inner}) WHERE {kept}"


def from_postgres(text: str) -> str:
    """The statement as Spark reads it. Unchanged: what both read alike; `/` of integers (use DIV) and averages of integers
    (both give doubles here)."""
    return _distinct_on(_lateral(_series(_matches(_parts(text.strip().rstrip(";"))))))

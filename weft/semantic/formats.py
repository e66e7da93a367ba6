"""Tuples as prompt text in five formats.

Fixed values of the formats: the XML elements header, row and column; the Markdown prefix COLUMN_ and its table without
columns; the marks [FTREE] and [ROOT attribute=value] of trees; a bar between values of encoded columns.

Flat formats take columns ``[{"name": .., "data": [..]}]``; a column without a name is called ``COLUMN <n>``. FTREE takes
``{"root": attribute, "order": [attributes], "tree": nodes}``; nodes are ``[(value, {child attribute: nodes})]``, each value with
what hangs below it.
"""

from __future__ import annotations

import json


def _names(columns: list[dict]) -> list[str]:
    out, n = [], 0
    for c in columns:
        if isinstance(c.get("name"), str):
            out.append(c["name"])
        else:
            n += 1
            out.append(f"COLUMN {n}")
    return out


def _dump(v) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _bare(v, null: str) -> str:
    if v is None:
        return null
    return v if isinstance(v, str) else _dump(v)


def _rows(columns: list[dict]) -> list[tuple]:
    return list(zip(*(c["data"] for c in columns)))


def xml(columns: list[dict]) -> str:
    def cells(values) -> str:
        return "".join(f"<column>{v}</column>" for v in values)

    out = f"<header>{cells(_names(columns))}</header>\n"
    rows = _rows(columns)
    if not rows:
        return out + "<row></row>\n"
    return out + "".join(f"<row>{cells(_bare(v, '') for v in row)}</row>\n" for row in rows)


def markdown(columns: list[dict]) -> str:
    if not columns:
        return " | Empty | \n | ----- | \n"

    def line(cells) -> str:
        return " | " + "".join(f"{c} | " for c in cells)

    names = _names(columns)
    titles = [f"COLUMN_{n}" if isinstance(c.get("name"), str) else n for c, n in zip(columns, names)]
    head = line(titles) + "\n" + line("-" * len(n) for n in names) + "\n"
    return head + "".join(line(map(_dump, row)) + "\n" for row in _rows(columns))


def json_object(columns: list[dict]) -> str:
    data = dict(zip(_names(columns), (c["data"] for c in columns)))
    return json.dumps(data, indent=4, sort_keys=True, ensure_ascii=False) + "\n"


def column_encoded(columns: list[dict]) -> str:
    lines = []
    for name, c in zip(_names(columns), columns):
        lines.append(f"- {name}: " + " | ".join(_bare(v, "null") for v in c.get("data") or []) + "\n")
    return "".join(lines)


def _void(nodes: list) -> bool:
    """Whether there is nothing but one NULL, and below it nothing."""
    return len(nodes) == 1 and nodes[0][0] is None and all(map(_void, nodes[0][1].values()))


def ftree(tree: dict) -> str:
    out = ["[FTREE]\n"]

    def children(below: dict, pad: str) -> None:
        for name, nodes in below.items():
            if _void(nodes):
                continue
            out.append(f"{pad}{name}:\n")
            for value, kids in nodes:
                out.append(f"{pad}  - {_bare(value, 'null')}\n")
                children(kids, pad + "    ")

    for value, below in tree["tree"]:
        out.append(f"[ROOT {tree['root']}={_bare(value, 'null')}] \n")
        children(below, "")
    return "".join(out)


_FLAT = {"JSON": json_object, "XML": xml, "MARKDOWN": markdown, "COLUMN_ENCODED": column_encoded}


def render(data, n: int, fmt: str) -> str:
    """The number of tuples, an empty line, and the tuples (columns, or a tree for FTREE)."""
    head = f"Number of tuples: {n}\n\n"
    return head + (ftree(data) if fmt == "FTREE" else _FLAT[fmt](data))


def flat_columns(rows: list[dict], names: tuple[str, ...]) -> list[dict]:
    """Columns in the order of ``names``."""
    return [{"name": n, "data": [r[n] for r in rows]} for n in names]


def _grow(rows: list[dict], parents: dict[str, str | None], every: str | None = None) -> list:
    """Nodes of the root attribute; of ``every`` each occurrence is a node of its own."""
    children: dict[str | None, list[str]] = {}
    for a, p in parents.items():
        children.setdefault(p, []).append(a)

    def nodes(a: str, of: list[dict]) -> list:
        if a == every:
            return [(r[a], {}) for r in of]
        groups: dict = {}
        for r in of:
            groups.setdefault(r[a], []).append(r)
        return [(v, {c: nodes(c, g) for c in children.get(a, ())}) for v, g in groups.items()]

    return nodes(children[None][0], rows)


def _tuples(nodes: list) -> int:
    """The number of tuples that nodes stand for: of independent branches every combination."""
    total = 0
    for _, below in nodes:
        n = 1
        for kids in below.values():
            n *= _tuples(kids)
        total += n
    return total


def build_tree(rows: list[dict], parents: dict[str, str | None]) -> dict:
    """A factorized tree of tuples. ``parents``: attribute to parent (None for the root), parents first.

    Values are listed in the order of the rows, each below its own parent's value. The tree stands for exactly the rows: where
    they are not all combinations of its branches (or repeat), each attribute hangs below the one before it instead.
    """
    names = list(parents)
    tree = _grow(rows, parents)
    if _tuples(tree) != len(rows):
        tree = _grow(rows, dict(zip(names, [None, *names])), names[-1])
    return {"root": names[0], "order": names, "tree": tree}

"""The prompt of a batch: what to do, how to answer, the user's request, the tuples."""

from __future__ import annotations

from .formats import render

_INSTRUCTIONS = """## Instructions
You annotate rows of a table. Read the request and answer it once for every row, in the order of the rows.
Use all columns of a row. Say nothing besides the answers.
If the table is given as a tree (it starts with [FTREE]), a row takes one root, one value of each list below it, and of each
list below a value that it takes. Every such combination is one row; there are as many as the number of tuples says. The
rows are ordered by the first attribute of the line "Order of rows", then by the second, and so on, each in the order in which the tree
lists its values. An attribute that the tree leaves out is empty.
"""
_RESPONSE = """## Response format
A JSON object {"items": [...]} whose list has exactly one answer for each row.
"""


def build_prompt(request: str, data, n: int, fmt: str) -> str:
    order = f"Order of rows: {', '.join(data['order'])}\n" if fmt == "FTREE" else ""
    return f"{_INSTRUCTIONS}\n{_RESPONSE}\n## Request\n{request}\n\n## Tuples\n{order}{render(data, n, fmt)}"

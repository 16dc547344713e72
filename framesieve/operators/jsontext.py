"""Text of nested JSON documents."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import TEXT_KEYS


def _walk(root, lists: bool):
    """Depth first with a stack of its own, so that no nesting is too deep."""
    stack = [iter([(None, root)])]
    while stack:
        try:
            key, node = next(stack[-1])
        except StopIteration:
            stack.pop()
            continue
        if isinstance(node, dict):
            stack.append(iter(list(node.items())))
        elif isinstance(node, list):
            stack.append(iter([((), value) for value in node]))
        elif key == ():
            if lists and isinstance(node, str):
                yield node
        elif key is not None and str(key).lower() in TEXT_KEYS and isinstance(node, str | int | float):
            yield str(node)


def flatten(text: str | None, lists: bool = False) -> str:
    """Values under the text keys, in order, joined by spaces; strings in lists only if lists; '' if invalid."""
    try:
        return " ".join(_walk(json.loads(text), lists)) if text else ""
    except (ValueError, RecursionError):  # the parser's own depth is bounded
        return ""


def json_text(column: Column, lists: bool = False) -> Column:
    """flatten() over a column, in Arrow batches."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([flatten(t, lists) for t in texts.to_pylist()], pa.string())

    return run(column)

"""Values as text with their type, read back without ever running the text."""

from __future__ import annotations

import ast
from typing import Any


def encode(value: Any) -> str:
    """Strings as they are, other values as ``value:type``."""
    return value if isinstance(value, str) else f"{value!r}:{type(value).__name__}"


def decode(text: str) -> Any:
    """The value of ``value:type`` if it is a literal of that type, None for "None", else the text itself."""
    if text == "None":
        return None
    body, colon, kind = text.rpartition(":")
    try:
        value = ast.literal_eval(body) if colon else text
    except (ValueError, SyntaxError):
        return text
    return value if colon and type(value).__name__ == kind else text


def by_prefix(config: dict[str, Any], separator: str = ":") -> dict[str, dict[str, Any]]:
    """Names grouped by what stands before the first separator; names without it under ""."""
    out: dict[str, dict[str, Any]] = {}
    for name, value in config.items():
        group, found, rest = name.partition(separator)
        out.setdefault(group if found else "", {})[rest if found else name] = value
    return out

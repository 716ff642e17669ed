"""Start values of declared members: literals, zeros by type, and writing at a member's path."""

from __future__ import annotations

import re
from typing import Any

#: Start values by type.
ZEROS: dict[str, Any] = {
    "bool": False,
    **dict.fromkeys(("real", "lreal"), 0.0),
    **dict.fromkeys(("string", "wstring", "char", "wchar"), ""),
    **dict.fromkeys(("byte", "word", "dword", "lword", "sint", "int", "dint", "lint", "usint", "uint", "udint", "ulint"), 0),
}


def literal_value(raw: str) -> Any:
    """``16#FF``, a truth value, a whole or broken number, else the text without its quotes."""
    text = raw.strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower().startswith("16#"):
        return int(text[3:], 16)
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip('"')


def zero_value(data_type: str) -> Any:
    """What a member starts from; null for a type without a start value."""
    array = re.match(r"(?i)^Array\[\s*-?\d+\s*\.\.\s*(-?\d+)\s*\]\s*of\s+(\w+)$", data_type.strip())
    if array:
        one = zero_value(array.group(2))
        return None if one is None else [zero_value(array.group(2)) for _ in range(int(array.group(1)) + 1)]
    return {} if data_type.strip().lower() == "struct" else ZEROS.get(data_type.strip().lower())


def put(root: dict, path: str, value: Any) -> None:
    """Writes at ``A``, ``A[3]``, ``S.A`` or ``S.A[3]``; any other path is left unset."""
    parts = [re.match(r"^(\w+)(?:\[\s*(-?\d+)\s*\])?$", p.strip()) for p in path.split(".")]
    if not all(parts) or any(p.group(2) for p in parts[:-1]):
        return
    for p in parts[:-1]:
        if not isinstance(root.get(p.group(1)), dict):
            root[p.group(1)] = {}
        root = root[p.group(1)]
    name, index = parts[-1].groups()
    if index is None:
        root[name] = value
        return
    if not isinstance(root.get(name), list):
        root[name] = []
    root[name] += [0] * (int(index) + 1 - len(root[name]))
    root[name][int(index)] = value

"""Glob patterns of repository names: `*` stays within a component; a component `**` takes the rest at the end, and any
components or none (with the slash after them) before it. Stars that share a component with anything else are single."""

from __future__ import annotations

import re


def tokens(pattern: str) -> list[str]:
    """The pattern in pieces: `**/`, a last `**`, and single characters."""
    return re.findall(r"(?<![^/])\*\*/|(?<![^/])\*\*\Z|.", pattern, re.S)


def to_regex(pattern: str) -> str:
    """An anchored regular expression for rlike."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}
    return "^" + "".join(parts.get(t) or re.escape(t) for t in tokens(pattern)) + "$"


def literal_length(pattern: str) -> int:
    """Characters that match themselves; the slash of `**/` isn't one."""
    return sum(not t.startswith("*") for t in tokens(pattern))


def stars(pattern: str) -> int:
    return sum(t.startswith("*") for t in tokens(pattern))

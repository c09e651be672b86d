"""Linguistic patterns over tagged tokens ``form|lemma|POS``."""

from __future__ import annotations

import re


def _field(part: str) -> str:
    """One field of a pattern's token as a regular expression; ``#`` captures."""
    if part == "#":
        return r"([^\s]+?)"
    if part == "":
        return r"[^\s]+?"
    if part.startswith("#"):
        return f"({part[1:]})"
    return part


def translate_pattern(pattern: str) -> str:
    """The regular expression of a pattern such as ``|#|NOUN #||NOUN``; ``.*`` stands for any field."""
    tokens = pattern.split()
    fields = [[_field(x) for x in t.replace(".*", r"[^\s]+").split("|")] for t in tokens]
    return "(" + " ".join(r"\|".join(f) for f in fields) + ")"


def captures(regex: str) -> int:
    """Number of groups within the outer one."""
    return re.compile(regex).groups - 1


def pattern_length(pattern: str) -> int:
    return len(pattern.split())

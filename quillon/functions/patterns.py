"""What can be known of a regular expression's matches without running it."""

from __future__ import annotations

from re import _constants as c
from re import _parser

SPECIAL = frozenset("\\[]^$*+?(){}|")
MOST = 64


def is_regex(pattern: str) -> bool:
    """Whether a pattern means more than its characters; a dot alone does not make it so."""
    return any(ch in SPECIAL for ch in pattern)


def trigrams(text: bytes) -> list[bytes]:
    """The distinct 3-byte windows without NUL, sorted."""
    return sorted({text[i : i + 3] for i in range(len(text) - 2) if 0 not in text[i : i + 3]})


def number(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


def variants(gram: bytes) -> list[bytes]:
    """The gram in all mixtures of ASCII case: up to eight."""
    out = [b""]
    for byte in gram:
        both = {bytes([byte]).lower(), bytes([byte]).upper()}
        out = [x + y for x in out for y in sorted(both)]
    return out


def required(pattern: str) -> list[list[str]]:
    """Groups of literals: every match holds a literal of each group. Empty if nothing is known.

    Runs of plain characters that every match must hold, and alternations whose
    branches all have such a run; anything else is passed over.
    """
    try:
        tree = _parser.parse(pattern)
    except Exception:
        return []
    if tree.state.flags & c.SRE_FLAG_IGNORECASE:
        return []
    groups = [[run] for run in _runs(tree)]
    for op, value in tree:
        if op is c.BRANCH:
            best = [max(_runs(branch), key=len, default="") for branch in value[1]]
            if all(best) and len(best) <= MOST:
                groups.append(best)
    return [g for g in groups if all(len(x.encode()) >= 3 for x in g)]


def _runs(tree) -> list[str]:
    runs, run = [], ""
    for op, value in tree:
        if op is c.LITERAL:
            run += chr(value)
            continue
        if op is c.SUBPATTERN and not value[1] and not value[2]:
            inner = _runs(value[3])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and value[0] >= 1:
            inner = _runs(value[2])
        else:
            inner = []
        runs += [run, *inner]
        run = ""
    return [r for r in [*runs, run] if r]

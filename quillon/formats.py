"""Answers as text: lines, Markdown with code, tables, and numbers for people."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

#: Lines of code that a Markdown answer shows from a definition on.
SNIPPET_LINES = 8
LINE_BYTES = 200


def human_bytes(n: float) -> str:
    """Bytes in the largest unit up to TB that leaves 1 or more, with one decimal."""
    units = ("B", "KB", "MB", "GB", "TB")
    power = 0 if n < 1 else min(int(math.log(n, 1024) + 1e-12), len(units) - 1)
    return f"{n / 1024**power:.1f} {units[power]}"


def eta(seconds: float) -> str:
    """A duration as 45s, 12m30s or 2h05m; a dash for what is no duration."""
    if not math.isfinite(seconds) or seconds < 0:
        return "—"
    minutes, rest = divmod(int(seconds + 0.5), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h{minutes:02}m" if hours else f"{minutes}m{rest:02}s" if minutes else f"{rest}s"


def cut(line: str, most: int = LINE_BYTES) -> str:
    """The line, or as many whole characters as fit so many bytes and a mark."""
    raw = line.encode("utf-8", "replace")
    return line if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "…"


def snippet(text: str | None, line: int, number: int = SNIPPET_LINES) -> str:
    """Lines of a text from a line on."""
    return "\n".join(map(cut, (text or "").split("\n")[max(0, line - 1) :][:number]))


def place(row: dict) -> str:
    return ":".join(str(row[k]) for k in ("path", "line", "col") if row.get(k) is not None)


def as_text(row: dict) -> str:
    """A line for people: place, kind and language, scope, name, and what it resolves to; search results show their line."""
    if "shown" in row:
        return f"{place(row)}: {row['shown']}" + (f"  [{row['fqn']}]" if row.get("fqn") else "")
    if "path" not in row or "line" not in row:
        return "  ".join(f"{k}={v}" for k, v in row.items())
    about = " ".join(str(row[k]) for k in ("kind", "lang") if row.get(k))
    parts = [place(row), f"({about})" if about else "", f"[{'::'.join(row['scope_path'])}]" if row.get("scope_path") else "", row.get("name", ""), f"→ {row['resolved_to']}" if row.get("resolved_to") else ""]
    return "  ".join(p for p in parts if p)


def as_path_line(row: dict) -> str:
    """PATH:LINE, as editors and other programs read it."""
    return f"{row['path']}:{row['line']}"


def section(row: dict, code: str) -> str:
    """A Markdown section: what it is, where it is, and its code."""
    about = " · ".join(str(row[k]).lower() for k in ("kind", "lang") if row.get(k))
    scope = f"**scope**: `{'::'.join(row['scope_path'])}`  \n" if row.get("scope_path") else ""
    return f"### `{row.get('name') or place(row)}`  ({about})\n**location**: `{place(row)}`  \n{scope}```{str(row.get('lang') or '').lower()}\n{code}\n```\n\n"


def markdown(rows: Sequence[dict], read: Callable[[str], str | None], budget: int | None = None) -> str:
    """A section for each row up to so many bytes, then how many were left out. read: path to text."""
    out, size = [], 0
    for k, row in enumerate(rows):
        part = section(row, snippet(read(row["path"]), row["line"]))
        size += len(part.encode())
        if budget and size > budget:
            out.append(f"_({len(rows) - k} more left out by the budget of {budget} bytes)_\n")
            break
        out.append(part)
    return "".join(out)


def table(rows: Sequence[dict], budget: int | None = None) -> str:
    """Rows without places as a Markdown table of up to so many bytes."""
    if not rows:
        return ""
    keys = list(rows[0])
    lines = ["| " + " | ".join(keys) + " |", "|" + " --- |" * len(keys), *("| " + " | ".join(str(r.get(k)).replace("|", "\\|") for k in keys) + " |" for r in rows)]
    size = sum(len(x.encode()) + 1 for x in lines) - 1
    while budget and len(lines) > 2 and size > budget:
        size -= len(lines.pop().encode()) + 1
    return "\n".join(lines)

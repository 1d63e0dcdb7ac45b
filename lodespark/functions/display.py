"""Text for people: sizes, times, highlighted terms, short paths."""

from __future__ import annotations

import re
from urllib.parse import quote


def size_text(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    value = float(n)
    for unit in ("KB", "MB", "GB", "TB"):
        value /= 1024
        if value < 1024 or unit == "TB":
            return f"{value:.1f} {unit}"
    raise AssertionError


def duration_text(seconds: float) -> str:
    s = int(seconds)
    return f"{seconds * 1000:.0f}ms" if seconds < 1 else f"{s}s" if s < 60 else f"{s // 60}m {s % 60}s" if s < 3600 else f"{s // 3600}h {s % 3600 // 60}m"


def age_text(seconds: float) -> str:
    for size, unit in ((86400, "d"), (3600, "h"), (60, "m")):
        if seconds >= size:
            return f"{int(seconds // size)}{unit} ago"
    return f"{int(seconds)}s ago"


def eta_text(done: int, total: int, seconds: float) -> str:
    return "..." if not done else duration_text(seconds / done * (total - done))


def highlight(text: str, query: str, before: str = "\x1b[1;33m", after: str = "\x1b[0m") -> str:
    """Marks the query's words of three letters or more."""
    terms = sorted({t for t in query.split() if len(t) >= 3}, key=len, reverse=True)
    return re.sub("|".join(map(re.escape, terms)), lambda m: before + m.group() + after, text, flags=re.I) if terms else text


def short_paths(paths: list[str]) -> dict[str, str]:
    """The shortest ends of paths, of two parts or more, that no other path has."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for p in paths:
        parts = [s for s in p.split("/") if s]
        for n in range(min(2, len(parts)), len(parts) + 1):
            end = "/".join(parts[-n:])
            if end not in taken:
                break
        else:
            end = p
        taken.add(end)
        out[p] = end
    return out


def editor_uri(template: str, path: str, line: int = 1, column: int = 1) -> str:
    """A template such as ``editor://open?file={path}&line={line}`` filled in; the path is escaped but for its slashes, and a line is 1 at least."""
    values = {"path": quote(path, safe="/"), "file": quote(path, safe="/"), "line": str(max(1, line)), "col": str(max(1, column)), "column": str(max(1, column))}
    return re.sub(r"\{(path|file|line|col|column)\}", lambda m: values[m.group(1)], template)

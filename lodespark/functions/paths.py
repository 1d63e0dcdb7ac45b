"""Paths, ids and globs: plain Python for single values, and columns for tables."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

SCHEME = "lode"


def _symbol(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk")


def _kept(c: str) -> bool:
    return c == "$" or unicodedata.category(c)[0] in "LN"


def symbols_to_hex(text: str) -> str:
    """Each run of symbols (emoji) becomes the hex code points of its members, joined by dashes."""
    out: list[str] = []
    previous = False
    for i, c in enumerate(text):
        if _symbol(c):
            out.append(("-" if previous else "") + f"{ord(c):x}")
            previous = True
        elif previous and unicodedata.category(c) == "Mn":
            continue  # a variation mark belongs to its symbol
        else:
            out.append(c)
            previous = False
    return "".join(out)


def _clean(segment: str) -> str:
    kept = "".join(c if _kept(c) else " " for c in segment)
    return re.sub(" +", "-", kept).strip("-")


def handelize(path: str) -> str:
    """A path of lower-case letters, digits, ``$`` and dashes; the extension of the file stays. Raises ValueError on a path without any usable file name."""
    if not path or not path.strip():
        raise ValueError("a path cannot be empty")
    last = [s for s in path.split("/") if s][-1:] or [""]
    stem = re.sub(r"\.[^.]+$", "", last[0])
    if not any(_kept(c) or _symbol(c) for c in stem):
        raise ValueError(f"path {path!r} has no usable file name")
    parts = [symbols_to_hex(s) for s in path.replace("___", "/").lower().split("/")]
    ext = re.search(r"\.[a-z0-9]+$", parts[-1])
    tail = ext.group() if ext else ""
    name = _clean(parts[-1][: len(parts[-1]) - len(tail)]) + tail
    out = "/".join(s for s in [*map(_clean, parts[:-1]), name] if s)
    if not out:
        raise ValueError(f"path {path!r} is empty after cleaning")
    return out


@pandas_udf(StringType())
def _handelize_symbols(paths: pd.Series) -> pd.Series:
    def one(p: str | None) -> str | None:
        try:
            return handelize(p) if p is not None else None
        except ValueError:
            return None

    return paths.map(one)


def handelized(path: Column) -> Column:
    """``handelize`` as a column; null where it would raise. Only paths with symbols leave the JVM."""
    parts = F.split(F.lower(F.replace(path, F.lit("___"), F.lit("/"))), "/")
    last = F.element_at(parts, -1)
    ext = F.regexp_extract(last, r"(\.[a-z0-9]+)$", 1)
    clean = lambda s: F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}$]+", "-"), r"^-+|-+$", "")
    name = F.concat(clean(F.substring(last, F.lit(1), F.length(last) - F.length(ext))), ext)
    whole = F.array_join(F.filter(F.concat(F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), clean), F.array(name)), lambda s: s != ""), "/")
    usable = F.regexp_replace(F.regexp_extract(path, r"([^/]+)/*$", 1), r"\.[^.]+$", "").rlike(r"[\p{L}\p{N}$]")
    return F.when(path.rlike(r"[\p{So}\p{Sk}]"), _handelize_symbols(path)).when(usable, whole)


def is_virtual(path: str) -> bool:
    return path.strip().startswith((f"{SCHEME}:", "//"))


def parse_virtual(path: str) -> tuple[str, str] | None:
    """``(collection, path)`` of ``lode://collection/path``, with any number of slashes, or of ``//collection/path``."""
    p = path.strip()
    if not is_virtual(p):
        return None
    m = re.match(r"/*([^/]+)/?(.*)$", p.removeprefix(f"{SCHEME}:"))
    return (m.group(1), m.group(2)) if m else None


def virtual_path(collection: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}://"), collection, F.lit("/"), path)


def normal_docid(docid: str) -> str:
    d = docid.strip()
    if len(d) > 1 and d[0] == d[-1] and d[0] in "\"'":
        d = d[1:-1]
    return d.removeprefix("#")


def is_docid(text: str) -> bool:
    return re.fullmatch(r"[a-fA-F0-9]{6,}", normal_docid(text)) is not None


def split_line_suffix(path: str) -> tuple[str, int | None]:
    """``name:12`` is the file ``name`` from line 12 on."""
    m = re.fullmatch(r"(.*):(\d+)", path)
    return (m.group(1), int(m.group(2))) if m else (path, None)


def is_absolute(path: str) -> bool:
    """Unix, Windows (``C:\\``, ``C:/``), Git Bash (``/c/``) and WSL (``/mnt/c/``) paths."""
    return path.startswith("/") or re.match(r"[A-Za-z]:[\\/]", path) is not None


def native_path(path: str) -> str:
    """Windows, Git Bash and WSL spellings of a drive become ``C:/``; backslashes become slashes."""
    p = path.replace("\\", "/")
    m = re.match(r"/(?:mnt/)?([A-Za-z])/(.*)$", p)
    return f"{m.group(1).upper()}:/{m.group(2)}" if m and not p.startswith("//") else p


def resolve(base: str, *parts: str) -> str:
    """Absolute path of ``parts`` from ``base``, without ``.`` and ``..``."""
    whole = base
    for p in parts:
        whole = p if is_absolute(p) else f"{whole}/{p}"
    root = "/" if whole.startswith("/") else ""
    out: list[str] = []
    for s in whole.replace("\\", "/").split("/"):
        if s == ".." and out:
            out.pop()
        elif s not in ("", ".", ".."):
            out.append(s)
    return root + "/".join(out)


def glob_regex(pattern: str) -> str:
    """A regular expression for whole paths: ``**/``, ``**``, ``*``, ``?``, ``[..]`` and ``{a,b}``."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def hidden(path: Column) -> Column:
    """Whether any segment of the path starts with a dot."""
    return F.exists(F.split(path, "/"), lambda s: s.startswith("."))

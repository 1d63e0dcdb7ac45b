"""Break points of program source: where declarations begin.

Python is parsed. For languages of braces the text is first masked (strings and comments become blanks of the same length), then declarations
are recognised line by line on what is left; a method is one only where the innermost open brace belongs to a class. A break lies
at the line end before a declaration, decorators included, like those of headings.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

# Languages by file extension, and scores on the scale of headings.
LANGUAGES = {".ts": "script", ".tsx": "script", ".js": "script", ".jsx": "script", ".mts": "script", ".cts": "script", ".mjs": "script", ".cjs": "script", ".py": "python", ".go": "go", ".rs": "rust"}
CONTAINER, FUNCTION, TYPE, IMPORT = 100.0, 90.0, 80.0, 60.0

_MASKED = {
    "script": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S),
    "go": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'|`[^`]*`?", re.S),
    "rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)\".*?(?:\"\1|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\[^\n]|[^'\\\n])'", re.S),
}
_SHARED = r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
_VISIBLE = r"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?"
_DECLARED = {
    "script": [
        (re.compile(_SHARED + r"(?:abstract[ \t]+)?(?:class|interface)[ \t]+[\w$]"), CONTAINER),
        (re.compile(_SHARED + r"(?:async[ \t]+)?function\b"), FUNCTION),
        (re.compile(_SHARED + r"(?:const|let)[ \t]+[\w$]+[^=\n]*=[ \t]*(?:async[ \t]*)?(?:function\b|(?:\([^\n]*\)|[\w$]+)[^\n;]*=>|\([^)\n]*$)"), FUNCTION),
        (re.compile(r"^[ \t]*export\b"), FUNCTION),
        (re.compile(_SHARED + r"(?:type[ \t]+[\w$]+[^=\n]*=|(?:const[ \t]+)?enum[ \t]+[\w$])"), TYPE),
        (re.compile(r"^[ \t]*import\b(?![ \t]*\()"), IMPORT),
    ],
    "go": [(re.compile(r"^func\b"), FUNCTION), (re.compile(r"^[ \t]*type\b"), TYPE), (re.compile(r"^import\b"), IMPORT)],
    "rust": [
        (re.compile(_VISIBLE + r"(?:unsafe[ \t]+)?(?:struct|impl|trait|mod)\b"), CONTAINER),
        (re.compile(_VISIBLE + r"(?:(?:default|const|async|unsafe|extern(?:[ \t]+\S+)?)[ \t]+)*fn[ \t]+\w"), FUNCTION),
        (re.compile(_VISIBLE + r"(?:enum|type)[ \t]+\w"), TYPE),
        (re.compile(_VISIBLE + r"use[ \t]"), IMPORT),
    ],
}
_METHOD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)[ \t]+)*\*?[ \t]*([#\w$]+)[ \t]*(?:<[^>\n]*>)?\(")
_STATEMENTS = {"if", "for", "while", "switch", "catch", "return", "function", "await", "new", "super", "throw", "typeof", "with"}
_DECORATOR = re.compile(r"^[ \t]*(?:@[\w$]|#!?\[)")


def language_of(path: str | None) -> str | None:
    """By the extension of the path; None for text of no known language."""
    m = re.search(r"\.[A-Za-z]+$", path or "")
    return LANGUAGES.get(m.group().lower()) if m else None


def python_breaks(text: str) -> dict[int, float]:
    """Break points before the classes, functions and imports of Python source; none if it can't be parsed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return {}
    offsets = [0]
    for line in text.split("\n"):
        offsets.append(offsets[-1] + len(line) + 1)
    kinds = ((ast.ClassDef, CONTAINER), ((ast.FunctionDef, ast.AsyncFunctionDef), FUNCTION), ((ast.Import, ast.ImportFrom), IMPORT))
    out: dict[int, float] = {}
    for node in ast.walk(tree):
        for kind, score in kinds:
            if isinstance(node, kind) and node.lineno > 1:
                first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
                out[max(0, offsets[first - 1] - 1)] = float(score)
    return out


def brace_breaks(text: str, language: str) -> dict[int, float]:
    """Break points before the declarations of a language of braces. Source that isn't closed, or isn't source, gives what can be recognised."""
    masked = _MASKED[language].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    rules, out = _DECLARED[language], {}
    classes: list[bool] = []  # of each open brace, whether it is that of a class
    at, start_of, pending = 0, None, False
    for line in masked.split("\n"):
        score = max((s for rx, s in rules if rx.match(line)), default=0.0)
        if language == "script" and not score and classes and classes[-1]:
            m = _METHOD.match(line)
            score = FUNCTION if m and m.group(1) not in _STATEMENTS else 0.0
        if _DECORATOR.match(line):
            start_of = at if start_of is None else start_of
        elif line.strip():
            if score and (first := at if start_of is None else start_of):
                out[first - 1] = max(score, out.get(first - 1, 0.0))
            start_of = None
        pending = pending or bool(re.search(r"\bclass\b", line))
        for c in re.findall(r"[{};]", line):
            if c == "{":
                classes.append(pending)
            elif c == "}" and classes:
                classes.pop()
            pending = False
        at += len(line) + 1
    return out


def breaks_for(path: str | None) -> Callable[[str], dict[int, float]] | None:
    """The break points of the language that a path names, as a function of the text; None where it names none."""
    language = language_of(path)
    if language is None:
        return None
    return python_breaks if language == "python" else lambda text: brace_breaks(text, language)

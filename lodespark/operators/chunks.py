"""Chunks of documents, cut at the best break points near the end of each window."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.operators.syntax import breaks_for
from lodespark.session import spread

MAX_CHARS, OVERLAP, WINDOW, DECAY = 3600, 540, 800, 0.7

# Break points and their scores.
BREAKS = [
    (r"\n#(?!#)", 100), (r"\n##(?!#)", 90), (r"\n###(?!#)", 80), (r"\n####(?!#)", 70), (r"\n#####(?!#)", 60), (r"\n######(?!#)", 50),
    (r"\n```", 80), (r"\n(?:---|\*\*\*|___)\s*\n", 60), (r"\n\n+", 20), (r"\n[-*]\s", 5), (r"\n\d+\.\s", 5), (r"\n", 1),
]
_COMPILED = [(re.compile(p), s) for p, s in BREAKS]
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def break_points(text: str) -> tuple[list[int], list[float]]:
    """Positions and scores, the best score at each position."""
    best: dict[int, float] = {}
    for rx, score in _COMPILED:
        for m in rx.finditer(text):
            best[m.start()] = max(best.get(m.start(), 0), score)
    at = sorted(best)
    return at, [best[p] for p in at]


def fences(text: str) -> list[tuple[int, int]]:
    """Code fences: from one line of back-ticks behind another to the next; an open one reaches to the end."""
    marks = [m.start() for m in re.finditer(r"\n```", text)]
    out = [(a, b + 4) for a, b in zip(marks[::2], marks[1::2])]
    return out + [(marks[-1], len(text))] if len(marks) % 2 else out


def best_cut(at: list[int], scores: list[float], target: int, closed: list[tuple[int, int]], window: int = WINDOW) -> int:
    """The break with the best score, less up to 70 % with the square of its distance; the first of equals. Without one, the target."""
    top, cut = -1.0, target
    for i in range(bisect_left(at, target - window), bisect_right(at, target)):
        p = at[i]
        j = bisect_left(closed, (p, -1)) - 1  # the last fence that starts before p
        if j >= 0 and closed[j][0] < p < closed[j][1]:
            continue
        score = scores[i] * (1 - DECAY * ((target - p) / window) ** 2)
        if score > top:
            top, cut = score, p
    return cut


def chunk_text(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, window: int = WINDOW, extra: Callable[[str], dict[int, float]] | None = None) -> list[tuple[int, str]]:
    """``(position, chunk)``; a text within the limit is one chunk. ``extra`` may add break points, such as those of a syntax tree."""
    if len(text) <= max_chars:
        return [(0, text)]
    at, scores = break_points(text)
    if extra:
        merged = dict(zip(at, scores))
        for p, s in extra(text).items():
            merged[p] = max(s, merged.get(p, 0))
        at = sorted(merged)
        scores = [merged[p] for p in at]
    closed, out, start = fences(text), [], 0
    while True:
        end = min(start + max_chars, len(text))
        if end < len(text):
            cut = best_cut(at, scores, end, closed, window)
            end = cut if start < cut <= end else end
        out.append((start, text[start:end]))
        if end >= len(text):
            return out
        start = end - overlap if end - overlap > start else end


def count_tokens(text: str) -> int:
    """Runs of letters, runs of digits, and other single marks: the offline stand-in for a model's tokenizer."""
    return len(TOKEN.findall(text))


def chunk_by_tokens(text: str, max_tokens: int = 900, overlap: int = 135, window: int = 200, count: Callable[[str], int] = count_tokens, extra: Callable[[str], dict[int, float]] | None = None) -> list[tuple[int, str, int]]:
    """``(position, chunk, tokens)``: first by 3 characters a token, then chunks with too many tokens again by the measured ratio, less 5 %."""
    out = []
    for pos, piece in chunk_text(text, max_tokens * 3, overlap * 3, window * 3, extra):
        n = count(piece)
        if n <= max_tokens:
            out.append((pos, piece, n))
            continue
        ratio = len(piece) / n
        size = max(1, int(max_tokens * ratio * 0.95))
        for sub, part in chunk_text(piece, size, min(int(overlap * ratio), size // 2), max(1, int(window * ratio))):
            out.append((pos + sub, part, count(part)))
    return out


def chunk_documents(docs: DataFrame, key: str, text: str, by_tokens: bool = False, strategy: str = "regex", path: str | None = None) -> DataFrame:
    """``key, seq, pos, chunk, n_tokens`` of each row; null texts give none, empty ones a single empty chunk.

    The strategy ``auto`` adds the declarations of program source to the break points, in the language that the extension in the column ``path``
    names; other texts, and all under the strategy ``regex``, are cut at headings, fences and paragraphs alone.
    """
    if strategy not in ("auto", "regex"):
        raise ValueError(f"unknown strategy {strategy!r}")
    schema = pa.schema([("key", pa.string()), ("seq", pa.int32()), ("pos", pa.int32()), ("chunk", pa.string()), ("n_tokens", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for k, t, where in zip(*(batch.column(i).to_pylist() for i in range(3))):
                extra = breaks_for(where)
                parts = chunk_by_tokens(t, extra=extra) if by_tokens else [(p, c, count_tokens(c)) for p, c in chunk_text(t, extra=extra)]
                for seq, (pos, chunk, n) in enumerate(parts):
                    for col, v in zip(cols, (k, seq, pos, chunk, n)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    where = F.col(path) if path and strategy == "auto" else F.lit(None)
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), where.cast("string").alias("path")).filter("text is not null")
    return spread(rows, "key").mapInArrow(run, "key string, seq int, pos int, chunk string, n_tokens int")


def best_chunk(chunks: DataFrame, terms: list[str], intent_terms: list[str] | None = None) -> DataFrame:
    """The chunk of each document that contains the most query terms (of more than two letters), intent terms counting half; the first of equals."""
    low = F.lower("chunk")
    score = F.lit(0.0)
    for t in terms:
        if len(t) > 2:
            score = score + F.contains(low, F.lit(t.lower())).cast("double")
    for t in intent_terms or []:
        score = score + 0.5 * F.contains(low, F.lit(t.lower())).cast("double")
    first = Window.partitionBy("key").orderBy(F.col("chunk_score").desc(), "seq")
    return chunks.withColumn("chunk_score", score).withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")

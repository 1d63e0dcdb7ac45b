"""Splitting oversized texts at natural boundaries, by agglomerative merging.

A text is first cut into atoms: lines, and in long lines sentences and runs of words. Each gap between atoms has
a strength (heading, fence, rule, paragraph, list item, line, sentence, word). A heap holds all gaps;
the weakest is closed first, as long as the joined piece and the overlap fit the limit. What
stays open are the strongest gaps that the limit allows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\s*$")
_ITEM = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])\s")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]+[”』」]*")
_SPACE = re.compile(r"\s+")

#: Strength of the gap before a line or after a sentence; within a fence all are weaker than outside.
HEADING, FENCE, RULE, PARAGRAPH, ITEM, LINE, SENTENCE, WORDS, NONE = 100, 80, 70, 50, 30, 20, 10, 4, 1


def atoms(text: str, largest: int) -> tuple[list[int], list[float]]:
    """Start of each atom, and the strength of the gap before it (the first is unused)."""
    starts: list[int] = []
    gaps: list[float] = []
    fence, blank, after_block = "", False, False
    for m in _LINE.finditer(text):
        if m.start() == m.end():
            break
        line, at = m.group(), m.start()
        mark = _FENCE.match(line)
        if fence:
            strength: float = 6 if blank else 5
            if mark and mark.group(1)[0] == fence[0] and len(mark.group(1)) >= len(fence) and not line.strip().strip(fence[0]):
                fence, after_block = "", True
                strength = 3
            blank = not line.strip()
        elif not line.strip():
            blank = True
            strength = NONE  # blank lines stay with what is before them
        else:
            head = _HEADING.match(line)
            if head:
                strength = HEADING - 2 * (len(head.group(1)) - 1)
            elif mark:
                strength, fence = FENCE, mark.group(1)
            elif after_block:
                strength = FENCE
            elif _RULE.match(line):
                strength = RULE
            elif blank:
                strength = PARAGRAPH
            else:
                strength = ITEM if _ITEM.match(line) else LINE
            after_block = blank = False
            if head:
                blank = False
        starts.append(at)
        gaps.append(strength)
        if len(line) > largest:
            _within(line, at, largest, starts, gaps)
    return starts, gaps


def _within(line: str, at: int, largest: int, starts: list[int], gaps: list[float]) -> None:
    """Gaps inside a long line: sentences, then words, then anywhere but within a cluster of marks."""
    cuts = [m.end() for m in _SENTENCE.finditer(line) if m.end() < len(line)]
    before = 0
    for cut in [*cuts, len(line)]:
        while cut - before > largest:
            spot = -1
            for m in _SPACE.finditer(line, before + largest // 2, before + largest):
                spot = m.end()
            strength: float = WORDS
            if spot <= before:
                spot, strength = before + largest, NONE
                while spot > before + 1 and (line[spot] == "\n" or ord(line[spot]) in (0x200D, 0xFE0F) or 0x300 <= ord(line[spot]) < 0x370 or line[spot - 1] == "‍"):
                    spot -= 1
            starts.append(at + spot)
            gaps.append(strength)
            before = spot
        if cut < len(line):
            starts.append(at + cut)
            gaps.append(SENTENCE)
        before = cut


def split_text(text: str, limit: int = 3600, overlap: int = 540) -> list[tuple[int, int, int]]:
    """``(start, core_start, end)`` of consecutive pieces that cover the text.

    Each piece has at most ``limit`` characters; each but the first starts ``overlap`` characters before
    its core, so that consecutive pieces share exactly so many. A text within the limit is one piece;
    an empty text is none.
    """
    if limit <= 2 * overlap or overlap < 0:
        raise ValueError("the limit must be more than twice the overlap")
    n = len(text)
    if n <= limit:
        return [(0, 0, n)] if n else []
    starts, gaps = atoms(text, max(1, min(limit - overlap, limit // 4)))
    count = len(starts)
    ends = [*starts[1:], n]
    after, before = list(range(1, count + 1)), list(range(-1, count - 1))
    alive = [True] * count
    heap = []
    for i in range(1, count):
        # The first piece holds at least the overlap that the second one takes from it.
        strength = -1.0 if starts[i] < overlap else gaps[i]
        heap.append((strength, ends[i] - starts[i - 1], i))
    heapq.heapify(heap)
    while heap:
        strength, size, i = heapq.heappop(heap)
        if not alive[i]:
            continue
        left = before[i]
        now = ends[i] - starts[left]
        if now + (overlap if left else 0) > limit:
            continue  # pieces only grow, so this gap stays open
        if now != size:
            heapq.heappush(heap, (strength, now, i))
            continue
        ends[left] = ends[i]
        alive[i] = False
        after[left] = after[i]
        if after[i] < count:
            before[after[i]] = left
    cores = [i for i in range(count) if alive[i]]
    return [(max(0, starts[i] - overlap) if i else 0, starts[i], ends[i]) for i in cores]


def _run(limit: int, overlap: int, with_text: bool):
    fields = [("key", pa.string()), ("seq", pa.int32()), ("start_pos", pa.int32()), ("core_pos", pa.int32()), ("end_pos", pa.int32())]
    schema = pa.schema(fields + [("piece", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for seq, (a, c, b) in enumerate(split_text(text, limit, overlap)):
                    for col, v in zip(out, (key, seq, a, c, b, text[a:b] if with_text else None)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)

    return run


def split_documents(docs: DataFrame, key: str, text: str, limit: int = 3600, overlap: int = 540, only_oversized: bool = True, with_text: bool = True) -> DataFrame:
    """Pieces ``key, seq, start_pos, core_pos, end_pos[, piece]`` of each text (offsets in code points).

    With ``only_oversized`` texts within the limit give no rows. Rows with a null key or text are left out; a
    key that is delivered twice, with the same text, counts once. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    if only_oversized:
        rows = rows.filter(F.char_length("text") > limit)
    schema = "key string, seq int, start_pos int, core_pos int, end_pos int" + (", piece string" if with_text else "")
    return rows.mapInArrow(_run(limit, overlap, with_text), schema).dropDuplicates(["key", "seq"])

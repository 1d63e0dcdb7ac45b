"""Output formats: columns for bulk output, and exact text for lists of results."""

from __future__ import annotations

import json

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodespark.functions.snippet import snippets


def csv_field(value: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line end; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.isNull(), F.lit("")).when(value.rlike('[,"\n]'), quoted).otherwise(value)


_XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_text(value: Column) -> Column:
    for a, b in _XML:
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def csv_value(value) -> str:
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text


def xml_value(text: str) -> str:
    for a, b in _XML:
        text = text.replace(a, b)
    return text


def with_snippets(spark: SparkSession, rows: list[dict], query: str, style: str) -> list[dict]:
    """The rows of one result with ``shown``: the snippet of each ``body`` (around ``chunk_pos``, if there is one), shorter in json."""
    if not rows:
        return []
    bodies = spark.createDataFrame([(i, r.get("body"), r.get("chunk_pos")) for i, r in enumerate(rows)], "i int, body string, pos int")
    shown = bodies.select("i", snippets(F.col("body"), F.lit(query), 300 if style == "json" else 500, F.col("pos")).alias("s"))
    by_row = {r["i"]: r["s"].asDict() if r["s"] else None for r in shown.collect()}
    return [r | {"shown": by_row[i]} for i, r in enumerate(rows)]


def _content(row: dict, full: bool, numbers: bool) -> tuple[str, int | None]:
    body = row.get("body") or ""
    shown = (row.get("shown") if body else None) or {"snippet": "", "line": None}
    text = body if full else shown["snippet"]
    if numbers and text:
        text = "\n".join(f"{i}: {line}" for i, line in enumerate(text.split("\n"), 1))
    return text, shown["line"]


def results_text(rows: list[dict], style: str, full: bool = False, numbers: bool = False) -> str:
    """Search results (``docid, score, file, title, context, body, shown``) as ``json``, ``csv``, ``files``, ``md`` or ``xml``.

    Scores have two decimals in json and files, four in csv; the ``file`` is the virtual path in all styles, and all are escaped.
    """
    if style == "json":
        out = []
        for r in rows:
            text, line = _content(r, full, numbers)
            item = {"docid": f"#{r['docid']}", "score": round(r["score"], 2), "file": r["file"], "line": line, "title": r["title"], "context": r.get("context"), "body" if full else "snippet": text}
            out.append({k: v for k, v in item.items() if v not in (None, "") or k in ("docid", "score", "file", "title")})
        return json.dumps(out, ensure_ascii=False, indent=2)
    if style == "csv":
        lines = ["docid,score,file,title,context,line,snippet"]
        for r in rows:
            text, line = _content(r, full, numbers)
            lines.append(",".join([f"#{r['docid']}", f"{r['score']:.4f}", csv_value(r["file"]), csv_value(r["title"]), csv_value(r.get("context")), csv_value(line), csv_value(text)]))
        return "\n".join(lines)
    if style == "files":
        return "\n".join(f"#{r['docid']},{r['score']:.2f},{csv_value(r['file'])}" + (f",{csv_value(r['context'])}" if r.get("context") else "") for r in rows)
    if style == "md":
        parts = []
        for r in rows:
            about = f"**context:** {r['context']}\n" if r.get("context") else ""
            parts.append(f"---\n# {r['title'] or r['file']}\n\n**docid:** `#{r['docid']}`\n{about}\n{_content(r, full, numbers)[0]}\n")
        return "\n".join(parts)
    if style == "xml":
        parts = []
        for r in rows:
            attrs = "".join(f' {k}="{xml_value(r[k])}"' for k in ("title", "context") if r.get(k))
            parts.append(f'<file docid="#{r["docid"]}" name="{xml_value(r["file"])}"{attrs}>\n{xml_value(_content(r, full, numbers)[0])}\n</file>')
        return "\n\n".join(parts)
    raise ValueError(f"unknown style {style!r}")

"""Models behind narrow interfaces, and deterministic stand-ins that need no files."""

from __future__ import annotations

import json
import math
import re
import struct
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.plans.query_document import SubQuery, default_expansion
from lodespark.schema import Descriptor

_WORD = re.compile(r"[^\W_]+")


class Encoder(Protocol):
    descriptor: Descriptor

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    name: str

    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Expander(Protocol):
    def expand(self, query: str, intent: str | None = None) -> list[SubQuery]: ...


class HashEncoder:
    """Signed feature hashing of words: cosine grows with the words that two texts share."""

    def __init__(self, dims: int = 64):
        self.descriptor = Descriptor("hash", f"words-{dims}", dims)

    def encode(self, texts: list[str]) -> np.ndarray:
        d = self.descriptor.dims
        out = np.zeros((len(texts), d), np.float32)
        for i, t in enumerate(texts):
            for w in _WORD.findall(t.lower()):
                h = xxhash.xxh64_intdigest(w)
                out[i, h % d] += 1 if h >> 63 else -1
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.maximum(n, 1e-12)


class RemoteEncoder:
    """An encoder behind HTTP: small requests and answers as JSON, from ``BINARY_FROM`` texts on answers as numbers.

    The request is ``{"texts": [...], "model": ...}``. A binary answer begins with the number of texts and of dimensions (four bytes each, little-endian), and
    holds that many 32-bit floats, no byte less or more. Whatever else comes raises, so that the batch counts as failed.
    """

    BINARY_FROM = 16

    def __init__(self, url: str, descriptor: Descriptor, timeout: float = 30.0, binary: bool = True):
        self.url, self.descriptor, self.timeout, self.binary = url, descriptor, timeout, binary

    def encode(self, texts: list[str]) -> np.ndarray:
        wanted = "application/octet-stream" if self.binary and len(texts) >= self.BINARY_FROM else "application/json"
        body = json.dumps({"texts": texts, "model": self.descriptor.model}).encode()
        asked = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Accept": wanted})
        with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
            data, kind = answer.read(), answer.headers.get_content_type()
        x = self.unpacked(data) if kind == "application/octet-stream" else np.asarray(json.loads(data)["embeddings"], np.float32)
        why = check_vectors(x, len(texts), self.descriptor.dims)
        if why:
            raise ValueError(why)
        return x

    @staticmethod
    def unpacked(data: bytes) -> np.ndarray:
        if len(data) < 8:
            raise ValueError("an answer without its head")
        count, dims = struct.unpack_from("<ii", data)
        if count < 0 or dims <= 0 or len(data) != 8 + 4 * count * dims:
            raise ValueError(f"{len(data)} bytes for {count} vectors of {dims} dimensions")
        return np.frombuffer(data, "<f4", offset=8).reshape(count, dims)


class OverlapScorer:
    """The share of query words in a text, squashed to (0, 1)."""

    name = "overlap"

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(_WORD.findall(query.lower()))
        share = [len(q & set(_WORD.findall(t.lower()))) / max(len(q), 1) for t in texts]
        return [1 / (1 + math.exp(-6 * (s - 0.5))) for s in share]


class PlainExpander:
    def expand(self, query: str, intent: str | None = None) -> list[SubQuery]:
        return default_expansion(query)


def check_vectors(x: np.ndarray, n: int, dims: int) -> str | None:
    """Why an encoder's answer can't be used, or None."""
    if x.ndim != 2 or x.shape[0] != n:
        return f"{n} texts, but {x.shape[0] if x.ndim else 0} vectors"
    if x.shape[1] != dims:
        return f"vectors of {x.shape[1]} dimensions, not {dims}"
    return None if np.isfinite(x).all() else "values that are not finite"


_PIECE = re.compile(r"\s*(?:[^\W\d_]+|\d+|[^\w\s]|_)")


def within_window(text: str, max_tokens: int | None, margin: int = 4) -> str:
    """The text, or as many of its tokens as a model's window holds, less a margin for the model's own marks."""
    if not max_tokens or len(text) <= max_tokens:
        return text  # no token is shorter than a character
    ends = [m.end() for m in _PIECE.finditer(text)]
    return text if len(ends) <= max_tokens else text[: ends[max(1, max_tokens - margin) - 1]]


def token_batches(sizes: list[int], budget: int, most: int) -> list[list[int]]:
    """Places of texts in batches of at most ``most`` texts whose padded size (texts times the longest) keeps to the budget; a longer text is alone."""
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):  # the last of a batch is its longest
        if out and len(out[-1]) < most and (len(out[-1]) + 1) * sizes[i] <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def resolve_encoder_options(given: dict | None = None, environment: dict | None = None) -> dict:
    """``backend, model, dims, url, timeout_ms, concurrency, binary, fail_closed``: what the caller gives, else the environment (``LODE_EMBED_...``), else the default.

    Numbers in the environment that are none, or not positive, are passed over. A remote backend fails closed unless told otherwise.
    """
    given, env = given or {}, environment or {}
    read = lambda name: env.get(f"LODE_EMBED_{name.upper()}")

    def number(name: str, default: int | None) -> int | None:
        if given.get(name) is not None:
            return given[name]
        text = (read(name) or "").strip()
        return int(text) if text.isdigit() and int(text) > 0 else default

    backend = given.get("backend") or (read("backend") or "").lower()
    backend = backend if backend in ("local", "remote") else "local"
    binary = given["binary"] if given.get("binary") is not None else (read("binary") or "1").lower() not in ("0", "false")
    return {
        "backend": backend, "model": given.get("model") or read("model") or "words-64", "dims": number("dims", None),
        "url": (given.get("url") or read("url") or f"http://127.0.0.1:{number('port', 8787)}").rstrip("/"), "timeout_ms": number("timeout_ms", 30_000), "concurrency": number("concurrency", 1),
        "binary": binary, "fail_closed": given["fail_closed"] if given.get("fail_closed") is not None else backend == "remote",
    }


def encode_chunks(chunks: DataFrame, encoder: Encoder, batch: int = 32, budget: int = 16_384, window: int | None = None) -> DataFrame:
    """``chunks(key, seq, pos, chunk, title)`` with ``embedding`` and ``error``.

    Batches hold texts of like length, at most ``batch``, whose padded tokens keep to the ``budget``. A batch that fails is halved and tried
    again, down to single texts, so that a text that is too large for memory spoils no other. With ``window`` texts are
    cut to the tokens that the model takes.
    """
    dims, template = encoder.descriptor.dims, encoder.descriptor.document_template
    fields = [("key", pa.string()), ("seq", pa.int32()), ("pos", pa.int32()), ("chunk", pa.string()), ("embedding", pa.list_(pa.float32())), ("error", pa.string())]
    schema = pa.schema(fields)

    def attempt(texts: list[str]) -> tuple[list, list]:
        try:
            x = np.asarray(encoder.encode(texts))
            why = check_vectors(x, len(texts), dims)
        except Exception as e:  # noqa: BLE001 - any failure of a model is an outcome, not the end of the job
            why = f"{type(e).__name__}: {e}"
        if why is None:
            return [v.astype(np.float32) for v in x], [None] * len(texts)
        if len(texts) == 1:
            return [None], [why[:200]]
        half = len(texts) // 2
        (va, ea), (vb, eb) = attempt(texts[:half]), attempt(texts[half:])
        return va + vb, ea + eb

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            key, seq, pos, text, title = (rb.column(i) for i in range(5))
            filled = [within_window(template.format(title=t or "", text=c).strip(), window) for t, c in zip(title.to_pylist(), text.to_pylist())]
            # Texts of like length share a batch; the order of the rows is restored.
            vecs: list = [None] * len(filled)
            errs: list = [None] * len(filled)
            for part in token_batches([len(_WORD.findall(t)) + 1 for t in filled], budget, batch):
                v, e = attempt([filled[i] for i in part])
                for i, a, b in zip(part, v, e):
                    vecs[i], errs[i] = a, b
            yield pa.RecordBatch.from_arrays([key, seq, pos, text, pa.array(vecs, pa.list_(pa.float32())), pa.array(errs, pa.string())], schema=schema)

    rows = chunks.select("key", "seq", "pos", "chunk", "title")
    return rows.mapInArrow(run, "key string, seq int, pos int, chunk string, embedding array<float>, error string")


def rerank(pairs: DataFrame, scorer: Scorer, cache: DataFrame | None = None) -> DataFrame:
    """``pairs(query, file, chunk)`` with ``score``; equal texts of a query are scored once, and those in ``cache(cache_key, score)`` not at all.

    A score is cached by the model, the query and the text, whatever file it is from; entries of an older form, by the file too, are read as well.
    A scorer that gives the wrong number of scores, or one that is not finite, scores 0.
    """
    keyed = pairs.withColumn("cache_key", F.sha2(F.concat_ws("\n", F.lit(scorer.name), "query", "chunk"), 256))
    todo = keyed.select("cache_key", "query", "chunk").dropDuplicates(["cache_key"])
    known = None
    if cache is not None:
        stored = cache.select("cache_key", "score").dropDuplicates(["cache_key"])
        by_file = F.sha2(F.concat_ws("\n", F.lit(scorer.name), "query", "file", "chunk"), 256)
        older = keyed.select("cache_key", by_file.alias("older")).join(stored.withColumnRenamed("cache_key", "older"), "older")
        known = todo.select("cache_key").join(stored, "cache_key").select("cache_key", "score", F.lit(0).alias("age")).unionByName(older.select("cache_key", "score", F.lit(1).alias("age")))
        known = known.groupBy("cache_key").agg(F.min_by("score", F.struct("age", "score")).alias("score"))
        todo = todo.join(known.select("cache_key"), "cache_key", "left_anti")
    schema = pa.schema([("cache_key", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            keys, queries, texts = (rb.column(i).to_pylist() for i in range(3))
            groups: dict[str, list[int]] = {}
            for i, q in enumerate(queries):
                groups.setdefault(q, []).append(i)
            out = [0.0] * len(keys)
            for q, rows in groups.items():
                got = scorer.score(q, [texts[i] for i in rows])
                if len(got) == len(rows) and all(math.isfinite(x) for x in got):
                    for i, x in zip(rows, got):
                        out[i] = float(x)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(out, pa.float64())], schema=schema)

    scored = todo.mapInArrow(run, "cache_key string, score double")
    if known is not None:
        scored = scored.unionByName(known)
    return keyed.join(scored, "cache_key", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))

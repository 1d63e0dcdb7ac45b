"""Schemas of stored tables, and the identity of an embedding space."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

CONTENT = "hash string, doc string, created_at timestamp"
DOCUMENTS = "collection string, path string, title string, hash string, modified_at timestamp, active int"
VECTORS = "hash string, seq int, pos int, chunk string, space_id string, embedding array<float>"
COLLECTIONS = "name string, path string, pattern string, ignore_patterns array<string>, include_by_default boolean, context map<string,string>"
EXPECTED = "hash string, fingerprint string, total_chunks long"
JOBS = "job_id string, fingerprint string, status string, n_pending long, n_chunks long, n_failed long, finished_at timestamp"


@dataclass(frozen=True)
class Descriptor:
    """What makes two vectors comparable."""

    backend: str
    model: str
    dims: int
    native_dims: int | None = None
    pooling: str = "mean"
    normalised: bool = True
    query_template: str = "{text}"
    document_template: str = "{title} {text}"
    dtype: str = "float32"
    version: int = 1

    @property
    def space_id(self) -> str:
        """24 hex digits over the sorted fields."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:24]


def check_space(stored: str | None, wanted: str) -> None:
    """Vectors of different spaces must not be compared."""
    if stored is not None and stored != wanted:
        raise ValueError(f"stored vectors are of space {stored}, the encoder gives {wanted}; embed anew or use the other encoder")


# Prompt templates of model families.
TEMPLATES = {
    "default": ("task: search result | query: {text}", "title: {title} | text: {text}"),
    "instruct": ("Instruct: Retrieve relevant documents for the given query\nQuery: {text}", "{title}\n{text}"),
    "prefix": ("search_query: {text}", "search_document: {text}"),
}


def templates(model: str) -> tuple[str, str]:
    low = model.lower()
    return TEMPLATES["instruct" if "qwen" in low else "prefix" if "nomic" in low else "default"]

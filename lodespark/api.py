"""The engine as one object: collections, contexts, updates, embedding, look-ups and search over versioned tables."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.functions.paths import SCHEME, is_docid, normal_docid, parse_virtual, split_line_suffix, virtual_path
from lodespark.operators import chunks, context, fusion, lexical, lookup, models, store
from lodespark.plans import hybrid
from lodespark.plans.query_document import SubQuery, parse_query_document
from lodespark.schema import COLLECTIONS, CONTENT, DOCUMENTS, EXPECTED, JOBS, VECTORS
from lodespark.sources.formats import results_text, with_snippets
from lodespark.sources.ingest import scan_files
from lodespark.session import cut_lineage
from lodespark.sources.versions import Versions

class Engine:
    """``root`` holds the tables. Encoder, scorer and expander are pluggable; the stand-ins need no models. ``strategy`` is how texts are cut, see ``chunk_documents``."""

    def __init__(self, spark: SparkSession, root: str, encoder: models.Encoder | None = None, scorer: models.Scorer | None = None, expander: models.Expander | None = None, strategy: str = "regex"):
        self.spark, self.tables, self.strategy = spark, Versions(spark, root), strategy
        self.encoder = encoder or models.HashEncoder()
        self.scorer = scorer or models.OverlapScorer()
        self.expander = expander or models.PlainExpander()
        self.global_context: str | None = None

    # Collections and contexts: a small table, overwritten by key.

    def collections(self) -> list[dict]:
        return [r.asDict() for r in self.tables.read("collections", COLLECTIONS).orderBy("name").collect()]

    def _save(self, rows: list[dict]) -> None:
        names = [c.split()[0] for c in COLLECTIONS.split(", ")]
        self.tables.write("collections", self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], COLLECTIONS))

    def add_collection(self, name: str, path: str, pattern: str = "**/*.md", ignore_patterns: list[str] | None = None, include_by_default: bool = True) -> None:
        rows = [r for r in self.collections() if r["name"] != name]
        old = next((r for r in self.collections() if r["name"] == name), {})
        self._save([*rows, {"name": name, "path": path, "pattern": pattern, "ignore_patterns": ignore_patterns or [], "include_by_default": include_by_default, "context": old.get("context") or {}}])

    def sync_config(self, config: dict | str) -> bool:
        """Makes the collections those of a configuration, as a dict or the path of a JSON (or YAML, where a parser is installed) file; returns whether anything was done.

        ``{"collections": {name: {"path": ..., "pattern": ..., "ignore": [...], "includeByDefault": ..., "context": {...}}}, "global_context": ...}``. The configuration
        wins: collections that it lacks are removed. One that is the same as at the last time, by its hash, is skipped.
        """
        if isinstance(config, str):
            text = self.spark.read.text(config, wholetext=True).first()["value"]
            if config.endswith((".yml", ".yaml")):
                import yaml  # only where it is installed

                config = yaml.safe_load(text)
            else:
                config = json.loads(text)
        mark = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
        self.global_context = config.get("global_context")
        seen = self.tables.read("config", "mark string").collect()
        if seen and seen[0]["mark"] == mark:
            return False
        wanted = config.get("collections") or {}
        for name in {c["name"] for c in self.collections()} - set(wanted):
            self.remove_collection(name)
        old = {c["name"]: c for c in self.collections()}
        self._save([
            {"name": n, "path": c["path"], "pattern": c.get("pattern") or "**/*.md", "ignore_patterns": c.get("ignore") or [], "include_by_default": c.get("includeByDefault", True), "context": c.get("context") or (old.get(n) or {}).get("context") or {}}
            for n, c in sorted(wanted.items())
        ])
        self.tables.write("config", self.spark.createDataFrame([(mark,)], "mark string"))
        return True

    def remove_collection(self, name: str) -> None:
        self._save([r for r in self.collections() if r["name"] != name])
        self.tables.write("documents", self.documents().filter(F.col("collection") != name))

    def rename_collection(self, old: str, new: str) -> None:
        rows = self.collections()
        if any(r["name"] == new for r in rows):
            raise ValueError(f"collection {new!r} exists")
        if not any(r["name"] == old for r in rows):
            raise KeyError(old)
        self._save([r | {"name": new if r["name"] == old else r["name"]} for r in rows])
        self.tables.write("documents", store.renamed_collection(self.documents(), old, new))

    def set_default(self, name: str, include: bool) -> None:
        self._save([r | ({"include_by_default": include} if r["name"] == name else {}) for r in self.collections()])

    def set_context(self, collection: str, prefix: str, text: str | None) -> None:
        """Sets the context of a path prefix; None removes it."""
        rows = self.collections()
        for r in rows:
            if r["name"] == collection:
                c = {k: v for k, v in (r["context"] or {}).items() if k != prefix}
                r["context"] = c if text is None else c | {prefix: text}
        self._save(rows)

    def contexts(self) -> DataFrame:
        c = self.tables.read("collections", COLLECTIONS).select(F.col("name").alias("collection"), F.explode("context").alias("prefix", "text"))
        return c.select("collection", F.when(F.startswith("prefix", F.lit("/")), F.col("prefix")).otherwise(F.concat(F.lit("/"), "prefix")).alias("prefix"), "text")

    # Tables.

    def documents(self) -> DataFrame:
        return self.tables.read("documents", DOCUMENTS)

    def content(self) -> DataFrame:
        return self.tables.read("content", CONTENT)

    def vectors(self) -> DataFrame:
        return self.tables.read("vectors", VECTORS)

    def update(self, names: list[str] | None = None) -> dict[str, int]:
        """Scans the collections and merges what was found; returns counts by status."""
        wanted = [c for c in self.collections() if names is None or c["name"] in names]
        scan = None
        for c in wanted:
            part = scan_files(self.spark, c["path"], c["name"], c["pattern"], c["ignore_patterns"])
            scan = part if scan is None else scan.unionByName(part)
        if scan is None:
            return {}
        scan = scan.dropDuplicates(["collection", "path"]).cache()
        docs, old = self.documents(), self.content()
        counts = {r["status"]: r["count"] for r in store.scan_diff(docs, scan).groupBy("status").count().collect()}
        fresh = store.new_content(old, scan.select("text")).select("hash", F.col("text").alias("doc"), F.current_timestamp().alias("created_at"))
        self.tables.write("content", old.unionByName(fresh))
        merged = store.merge_documents(docs, scan).join(scan.select("collection", "path", F.col("modified_at").alias("seen_at")), ["collection", "path"], "left")
        merged = merged.join(docs.select("collection", "path", F.col("modified_at").alias("old_at")), ["collection", "path"], "left")
        self.tables.write("documents", merged.select("collection", "path", "title", "hash", F.coalesce("seen_at", "old_at").alias("modified_at"), "active"))
        scan.unpersist()
        orphans = store.orphaned_content(self.content(), self.documents()).count()
        return {s: counts.get(s, 0) for s in ("indexed", "updated", "unchanged", "removed")} | {"orphaned": orphans}

    def cleanup(self) -> dict[str, int]:
        """Drops inactive documents, orphaned content and orphaned vectors, and old versions."""
        docs = self.documents().filter("active = 1")
        self.tables.write("documents", docs)
        keep = self.documents().select("hash").distinct()
        self.tables.write("content", self.content().join(keep, "hash", "left_semi"))
        self.tables.write("vectors", self.vectors().join(keep, "hash", "left_semi"))
        return {t: self.tables.vacuum(t) for t in ("documents", "content", "vectors", "collections", "jobs")}

    # Embedding.

    def _fingerprint(self) -> str:
        parts = f"{self.encoder.descriptor.space_id}|{self.strategy}|{chunks.MAX_CHARS}|{chunks.OVERLAP}"
        return hashlib.sha256(parts.encode()).hexdigest()[:24]

    def _chunks(self, rows: DataFrame) -> DataFrame:
        return chunks.chunk_documents(rows, "hash", "doc", strategy=self.strategy, path="path")

    def embed(self, force: bool = False, max_failures: float = 0.8, batch_docs: int = 100_000) -> dict:
        """Embeds what is pending, in batches of about ``batch_docs`` texts, each of which is stored before the next begins.

        A broken-off job goes on with what no stored batch holds: how many chunks a text has is stored with its vectors, so nothing that is complete
        is cut or encoded again, and vectors are added, not rewritten. The job stops after the first batch by which more than ``max_failures`` of all
        chunks so far have failed; what that batch could encode is not stored then. A stored job with another fingerprint (model,
        strategy, size) is refused unless ``force`` starts anew.
        """
        began = time.time()
        jobs = self.tables.read("jobs", JOBS)
        last = jobs.orderBy(F.col("finished_at").desc()).limit(1).collect()
        fingerprint = self._fingerprint()
        if last and last[0]["fingerprint"] != fingerprint and not force:
            raise ValueError("the stored vectors were made with another model or strategy; use force to embed anew")
        if force or not self.tables.current("vectors"):
            self.tables.write("vectors", self.spark.createDataFrame([], VECTORS))
            self.tables.write("expected", self.spark.createDataFrame([], EXPECTED))
        docs, content = self.documents().filter("active = 1"), self.content().filter("doc is not null and length(doc) > 0")
        expected = self.tables.read("expected", EXPECTED).filter(F.col("fingerprint") == fingerprint).groupBy("hash").agg(F.max("total_chunks").alias("total_chunks"))
        pending = cut_lineage(store.pending_embeddings(docs, content, self.vectors(), expected).select("hash"))
        n_batches = max(1, -(-pending.count() // batch_docs))
        about = docs.groupBy("hash").agg(F.min("title").alias("title"), F.min("path").alias("path"))
        done = {"docs": 0, "n": 0, "failed": 0}
        status = "complete"
        for batch in range(n_batches):
            part = pending if n_batches == 1 else pending.filter(F.pmod(F.xxhash64("hash"), F.lit(n_batches)) == batch)
            cut = self._chunks(content.join(part, "hash", "left_semi").join(about.select("hash", "path"), "hash"))
            rows = cut.join(about.select(F.col("hash").alias("key"), "title"), "key")
            rows = rows.join(self.vectors().select(F.col("hash").alias("key"), "seq"), ["key", "seq"], "left_anti")
            coded = cut_lineage(models.encode_chunks(rows, self.encoder))
            counts = coded.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed"), F.count_distinct("key").alias("docs")).first()
            done = {k: v + counts[k] for k, v in done.items()}
            if done["n"] and done["failed"] / done["n"] > max_failures:
                status = "failed"
                break
            status = "partial" if done["failed"] else "complete"
            if counts["n"]:
                good = coded.filter("error is null").select(F.col("key").alias("hash"), "seq", "pos", "chunk", F.lit(self.encoder.descriptor.space_id).alias("space_id"), "embedding")
                # The expectations first: should the job end between the two, the texts are pending still.
                self.tables.append("expected", cut.groupBy(F.col("key").alias("hash")).agg(F.count(F.lit(1)).alias("total_chunks")).select("hash", F.lit(fingerprint).alias("fingerprint"), "total_chunks"))
                self.tables.append("vectors", good)
        row = self.spark.createDataFrame([(f"{time.time_ns()}", fingerprint, status, done["docs"], done["n"], done["failed"])], "job_id string, fingerprint string, status string, n_pending long, n_chunks long, n_failed long")
        self.tables.append("jobs", row.withColumn("finished_at", F.current_timestamp()))
        return {"status": status, "documents": done["docs"], "chunks": done["n"], "failed": done["failed"], "seconds": round(time.time() - began, 3)}

    def clear_embeddings(self) -> None:
        for name, schema in (("vectors", VECTORS), ("expected", EXPECTED), ("jobs", JOBS)):
            self.tables.write(name, self.spark.createDataFrame([], schema))

    # Look-ups.

    def _active(self, collections: list[str] | None = None) -> DataFrame:
        docs = self.documents().filter("active = 1")
        if collections:
            return docs.filter(F.col("collection").isin(collections))
        wanted = [c["name"] for c in self.collections() if c["include_by_default"] is False]
        return docs.filter(~F.col("collection").isin(wanted)) if wanted else docs

    def _query(self, name: str) -> tuple[DataFrame, int | None]:
        name, line = split_line_suffix(name.strip())
        virtual = parse_virtual(name)
        if virtual:
            name = "/".join(virtual)
        if is_docid(name):
            name = normal_docid(name)
        return self.spark.createDataFrame([(name,)], "query string"), line

    def get(self, name: str, from_line: int | None = None, max_lines: int | None = None) -> dict:
        """A document by id, virtual path, ``collection/path`` or the end of its path, or the nearest paths as ``similar``."""
        query, line = self._query(name)
        docs = self.documents().filter("active = 1")
        hit = lookup.find_documents(docs, query).limit(1)
        rows = hit.join(self.content(), "hash").select("collection", "path", "hash", "doc").collect()
        if not rows:
            near = lookup.fuzzy_lookup(docs, query).orderBy("distance", "path").collect()
            return {"error": "not found", "query": name, "similar": [r["path"] for r in near]}
        r = rows[0]
        text = r["doc"]
        start = from_line or line
        if start or max_lines:
            lines = text.split("\n")[(start or 1) - 1 :]
            text = "\n".join(lines[:max_lines] if max_lines else lines)
        one = self.spark.createDataFrame([(r["collection"], r["path"])], "collection string, path string")
        about = context.inherited_context(one, self.contexts(), self.global_context).first()["context"]
        return {"file": f"{SCHEME}://{r['collection']}/{r['path']}", "docid": r["hash"][:6], "hash": r["hash"], "body": text, "context": about}

    def multi_get(self, pattern: str, max_bytes: int = lookup.MAX_BYTES, max_lines: int | None = None) -> list[dict]:
        """Documents of a comma-separated list, or of a glob; with ``max_lines`` longer bodies are cut, with a note."""
        docs = self.documents().filter("active = 1")
        if any(c in pattern for c in "*?{"):
            hits = lookup.glob_lookup(docs, pattern)
        else:
            names = self.spark.createDataFrame([(p.strip(),) for p in pattern.split(",") if p.strip()], "query string")
            hits = docs.join(lookup.find_documents(docs, names).select("collection", "path").distinct(), ["collection", "path"])
        return [r.asDict() for r in lookup.multi_get(hits, self.content(), max_bytes, max_lines).orderBy("collection", "path").collect()]

    def list_files(self, collection: str, prefix: str = "") -> list[str]:
        rows = self.documents().filter((F.col("active") == 1) & (F.col("collection") == collection) & F.col("path").startswith(prefix))
        return [r["path"] for r in rows.select("path").orderBy("path").collect()]

    # Search.

    def _files(self, collections: list[str] | None) -> DataFrame:
        docs = self._active(collections).join(self.content().select("hash", "doc"), "hash")
        return docs.select(virtual_path(F.col("collection"), F.col("path")).alias("file"), F.concat_ws("/", "collection", "path").alias("filepath"), "title", F.col("doc").alias("body"), "hash", "collection", "path")

    def _finish(self, hits: DataFrame, files: DataFrame) -> list[dict]:
        about = context.inherited_context(files.select("collection", "path"), self.contexts(), self.global_context)
        full = F.broadcast(hits).join(files, "file").join(about, ["collection", "path"], "left")
        out = full.withColumn("docid", store.docid(F.col("hash"))).drop("filepath", "hash", "collection", "path").orderBy("rank")
        return [r.asDict(recursive=True) for r in out.collect()]

    def search_lex(self, query: str, limit: int = 20, collections: list[str] | None = None, min_score: float = 0.0) -> list[dict]:
        lexical.validate_lex(query)
        files = self._files(collections)
        hits = lexical.search(files, [("q", query)], limit).filter(F.col("score") >= min_score).select("file", "score", "rank")
        return self._finish(hits, files)

    def search_vector(self, query: str, limit: int = 10, collections: list[str] | None = None, min_score: float = 0.3) -> list[dict]:
        lexical.validate_semantic(query)
        files = self._files(collections)
        texts = [query, *(s.query for s in self.expander.expand(query) if s.type in ("vec", "hyde"))]
        hits = hybrid.vector_hits(self.vectors(), files, self.encoder, texts, limit).withColumn("q", F.lit(0))
        return self._finish(fusion.final_results(hits, ["q"], "file", "score", min_score, limit).select("file", "score", "rank"), files)

    def expand_query(self, query: str, intent: str | None = None) -> list[SubQuery]:
        return self.expander.expand(query, intent)

    def search(self, query: str, collections: list[str] | None = None, options: hybrid.Options | None = None) -> list[dict]:
        """A plain query is expanded unless its best keyword hit stands out; a query document is run as it is."""
        o = options or hybrid.Options()
        files = self._files(collections)
        parsed = parse_query_document(query)
        if parsed:
            o = replace(o, intent=o.intent or parsed.intent)
            searches = [("original" if i == 0 and s.type == "lex" else s.type, s) for i, s in enumerate(parsed.searches)]
            for s in parsed.searches:
                (lexical.validate_lex if s.type == "lex" else lexical.validate_semantic)(s.query)
            if searches[0][0] == "original" and all(s.type == "lex" for s in parsed.searches):
                searches[0] = ("lex", searches[0][1])
            asked = " ".join(s.query for s in parsed.searches)
        else:
            asked = query.removeprefix("expand:").strip()
            searches = [("original", SubQuery("lex", asked))]
            strong = False
            if not o.intent:
                top = lexical.search(files, [("q", asked)], 2).select(F.lit("q").alias("q"), "file", "score")
                row = fusion.strong_signal(top, ["q"], "score").first()
                strong = bool(row and row["strong"])
            if not strong:
                searches += [(s.type, s) for s in self.expander.expand(asked, o.intent)]
        hits = hybrid.hybrid(files, self.vectors() if self.tables.current("vectors") else None, self.encoder, self.scorer, asked, searches, o)
        return self._finish(hits, files)

    def format(self, rows: list[dict], style: str, query: str = "", full: bool = False) -> str:
        return results_text(with_snippets(self.spark, rows, query, style), style, full)

    # Status.

    def status(self) -> dict:
        docs = self.documents()
        n = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when(F.col("active") == 1, 1).otherwise(0)).alias("active"), F.max("modified_at").alias("last_modified")).first().asDict()
        per = store.collection_status(docs).orderBy("collection").collect()
        return n | {"vectors": self.vectors().count(), "collections": [r.asDict() for r in per]}

    def health(self, stale_days: int = 14) -> list[str]:
        """Warnings: stale indexes, documents without vectors."""
        out = []
        s = self.status()
        if s["last_modified"] is not None and time.time() - s["last_modified"].timestamp() > stale_days * 86400:
            out.append(f"nothing was modified for {stale_days} days; run update")
        bare = self.documents().filter("active = 1").join(self.vectors().select("hash"), "hash", "left_anti").select("hash").distinct().count()
        if bare:
            out.append(f"{bare} texts have no vectors; run embed")
        return out


def matches(names: list[str], pattern: str) -> list[str]:
    """Collections by name or shell pattern."""
    return [n for n in names if fnmatch.fnmatchcase(n, pattern)]

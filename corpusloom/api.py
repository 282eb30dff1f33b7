"""The engine's requests over an index folder: index, search, list, chunk, read, tables, contents and content."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import content, hierarchy, search
from corpusloom.operators.ann import VectorIndex
from corpusloom.operators.chunking import chunk_documents
from corpusloom.operators.structure import boundary_rows, detect
from corpusloom.operators.vectors import hash_embedding, with_neighbours
from corpusloom.runtime import cut
from corpusloom.schema import ChunkOptions, SearchParams
from corpusloom.sources import files
from corpusloom.sources.store import Store
from corpusloom.validate import NotFound, respond, validate


def ingest(store: Store, docs: DataFrame, options: ChunkOptions | None = None) -> None:
    """Index loaded documents in place of their sources' older rows.

    Files are read and structured once (what comes out is written to the shared folder), chunks are packed once, and
    vectors and words come from the chunks as stored.  Row-local work up to the store's own exchange by bucket.
    """
    ready = cut(detect(docs.select("source", "path", "file_type", "content", "loader"), "content", "bounds", "loader").drop("loader"))
    chunks = chunk_documents(ready, "source", "source", "content", options, bounds="bounds")
    embed = lambda rows: rows.select("chunk_id", "source", hash_embedding(F.col("content")).alias("embedding"))
    store.save(ready.select("source", "path", "file_type"), chunks, boundary_rows(ready, ["source"], "bounds"), embed)


class Engine:
    """Requests by name with plain arguments; :meth:`call` validates and answers in JSON.

    ``embed`` turns a query into a vector of the index's space; the default is the hashing embedder of the ingest.  With
    ``ann`` a search reads only the nearest ``probes`` lists of that vector index (built from the store's vectors by
    :meth:`index_vectors`) instead of all vectors.
    """

    def __init__(self, spark: SparkSession, index: str | None = None, root: str | None = None, embed: Callable[[str], list[float]] | None = None, ann: VectorIndex | None = None, probes: int = 16) -> None:
        self.spark, self.root, self.ann, self.probes = spark, root, ann, probes
        self.store = Store(spark, files.index_dir(index))
        self.embed = embed or (lambda q: spark.range(1).select(hash_embedding(F.lit(q)).alias("v")).first()["v"])

    def index_vectors(self, path: str) -> None:
        """Build the approximate index over all vectors stored so far and search it from now on."""
        self.ann = VectorIndex.build(self.store.read("vectors"), path)

    def call(self, request: str, arguments: dict) -> str:
        return respond(lambda: getattr(self, request)(**validate(request, arguments)))

    def _known(self, source: str) -> None:
        if self.store.read("manifest", source).isEmpty():
            raise NotFound(f"source '{source}' is not indexed", "source_name", "see doc_list for what is indexed, or index the document first with doc_index")

    def doc_index(self, file_path: str, source_name: str | None = None) -> dict:
        path = files.resolve(file_path, self.root)
        kind = files.check_file(path)
        docs = files.load_documents(self.spark, path, source_name)
        ingest(self.store, docs)
        name = docs.select("source").first()["source"]
        row = self.store.read("manifest", name).first()
        return {"source": name, "file_type": kind, "chunks": row["chunks"], "has_boundaries": row["has_boundaries"]}

    def doc_search(self, query: str, sources=None, top_k=5, include_context=True, expand_to_boundary=None, max_return_tokens=4096, include_siblings=False) -> dict:
        params = SearchParams(query, tuple(sources) if sources else None, top_k, include_context, expand_to_boundary, max_return_tokens, include_siblings)
        chunks, vectors = self.store.read("chunks"), self.store.read("vectors")
        vector = list(self.embed(query))
        if self.ann is not None:
            vectors = self.ann.pool(vector, self.probes)
        ranked = search.hybrid_search(chunks, vectors, vector, params, self.store.read("words"))
        if not expand_to_boundary:
            rows = search.within_budget(ranked, max_return_tokens).orderBy(F.desc("score"), "chunk_id").collect()  # at most top_k
            total = max((r["total_tokens"] for r in rows), default=0)
            return {"query": query, "results": [_item(r) for r in rows], "total_tokens": total, "expansion_applied": None}
        # Each item's budget depends on what the items before it used: at most top_k small requests.
        items, total, applied = [], 0, None
        for row in ranked.orderBy(F.desc("score"), "chunk_id").collect():
            item = _item(row)
            if row["boundary_id"] is not None:
                hit = self.spark.createDataFrame([(row["source"], row["chunk_id"], row["boundary_id"])], "source string, chunk_id string, boundary_id string")
                own, bounds = (self.store.read(t, row["source"]) for t in ("chunks", "boundaries"))
                wide = search.expand(hit, own, bounds, ["source"], expand_to_boundary, max_return_tokens - total, include_siblings).first()
                if wide is not None and wide["expanded_content"] is not None:
                    item |= {"expanded_content": wide["expanded_content"], "boundary_info": {"id": wide["expanded_id"], "type": wide["expanded_type"], "level": wide["expanded_level"], "title": wide["expanded_title"], "chunk_count": wide["chunk_count"]}}
                    total += wide["expanded_tokens"]
                    applied = expand_to_boundary
            items.append(item)
            if total >= max_return_tokens:
                break
        return {"query": query, "results": items, "total_tokens": total, "expansion_applied": applied}

    def doc_list(self) -> dict:
        rows = [r.asDict() for r in self.store.read("manifest").orderBy("source").toLocalIterator()]
        return {"sources": rows, "count": len(rows)}

    def doc_chunk(self, chunk_id: str, neighbors: int = 0) -> dict:
        chunks = self.store.read("chunks", chunk_id.rpartition(":")[0])
        row = chunks.where(F.col("chunk_id") == chunk_id).first()
        if row is None:
            raise NotFound(f"no chunk '{chunk_id}'", "chunk_id", "see doc_search for chunk ids")
        out = {"chunk": _sparse(row)}
        if neighbors:
            near = with_neighbours(chunks, self.spark.createDataFrame([(chunk_id,)], "chunk_id string"), neighbors)
            out["neighbors"] = [_sparse(r) for r in near.orderBy("position").collect()]
        return out

    def read_document(self, file_path: str, max_chars: int = 100_000, include_metadata: bool = True) -> dict:
        path = files.resolve(file_path, self.root)
        files.check_file(path)
        row = files.read_document(files.load_documents(self.spark, path), max_chars).first()
        out = {k: row[k] for k in ("content", "file_type", "truncated", "char_count")}
        return out | ({"metadata": row["facts"]} if include_metadata else {})

    def list_tables(self, file_path: str) -> dict:
        path = files.resolve(file_path, self.root)
        files.check_file(path)
        rows = files.list_tables(self.spark, path).drop("rows", "path").orderBy("table_index").collect()
        return {"tables": [r.asDict() for r in rows], "count": len(rows)}

    def extract_table(self, file_path: str, table_index: int, max_rows: int | None = None, include_headers: bool = True) -> dict:
        path = files.resolve(file_path, self.root)
        files.check_file(path)
        found = files.extract_table(self.spark, path, table_index, max_rows)
        about = {k: found[k] for k in ("table_index", "location", "headers", "row_count", "col_count")}
        return {"file_path": file_path, **about, "csv": files.table_csv(found, include_headers)}

    def doc_toc(self, source_name: str, max_depth: int = 3) -> dict:
        self._known(source_name)
        bounds, chunks = (self.store.read(t, source_name) for t in ("boundaries", "chunks"))
        rows = hierarchy.toc(bounds, chunks, ["source"], max_depth).collect()  # one document's headings
        tree = hierarchy.toc_tree([r.asDict() for r in rows])
        return {"source_name": source_name, "toc": tree, "total_entries": hierarchy.toc_size(tree)}

    def doc_get_content(self, source_name: str, boundary_id=None, chapter=None, section=None, pages=None, max_return_tokens=8192, include_children=True) -> dict:
        self._known(source_name)
        chunks, bounds, keys = self.store.read("chunks", source_name), self.store.read("boundaries", source_name), ["source"]
        if boundary_id is not None:
            found = content.by_boundary(chunks, bounds, keys, boundary_id, include_children, max_return_tokens)
        elif pages is not None:
            first, _, last = pages.partition("-")
            found = content.by_pages(chunks, keys, int(first), int(last or first), max_return_tokens)
        else:
            found = content.by_title(chunks, bounds, keys, chapter or section, "chapter" if chapter else None, include_children, max_return_tokens)
        row = found.first()
        if row is None or not row["content"]:
            raise NotFound("no content at that place", None, "see doc_toc for the boundaries of the source")
        return {"source_name": source_name} | {k: v for k, v in _sparse(row).items() if k != "source"}


def _sparse(row) -> dict:
    return {k: v for k, v in row.asDict().items() if v is not None}


def _item(row) -> dict:
    meta = ("position", "total_chunks", "boundary_type", "boundary_id", "boundary_title", "token_count")
    out = {k: row[k] for k in ("chunk_id", "source", "score", "content")} | {"metadata": {k: row[k] for k in meta}}
    out |= {k: row[k] for k in ("text_score", "match_type") if row[k] is not None}
    around = {k: row[k] for k in ("before", "after") if k in row.__fields__ and row[k] is not None}
    return out | ({"context": around} if around else {})

"""The engine's surface: indexing into versioned tables and searching them."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import chunk as K
from plinth.functions import encode as E
from plinth.functions import paths as P
from plinth.functions import text as T
from plinth.operators import catalog as C
from plinth.operators import postings as I
from plinth.operators import ranking as R
from plinth.operators import retrieval as V
from plinth.operators import versioned as W
from plinth.sources import files as S

SOURCES = ("vault", "codebase", "document")


class FilterError(ValueError):
    pass


#: Filters that each source takes.
FILTERS = {
    "vault": ("doc_type", "feature", "date", "tag", "status", "intent"),
    "codebase": ("language", "path", "path_scope", "node_type", "function_name", "class_name", "include_paths", "exclude_paths", "prefer", "exclude_domain", "only_domain", "include_domain"),
    "document": ("source_path", "title", "section", "extractor_id"),
}


def validated(source: str, filters: dict) -> dict:
    """filters without empty ones; FilterError for one that the source doesn't take, or a value it doesn't know."""
    used = {k: v for k, v in filters.items() if v}
    for name in used:
        if name not in FILTERS[source]:
            raise FilterError(f"{source} takes no filter {name}")
    for kind in str(used.get("doc_type", "")).split(","):
        if kind and kind not in T.DOC_TYPES:
            raise FilterError(f"unknown record type {kind}")
    if used.get("prefer") not in (None, "prod", "tests", "docs"):
        raise FilterError(f"unknown preference {used['prefer']}")
    for name in ("exclude_domain", "only_domain", "include_domain"):
        for d in used.get(name, "").split(","):
            if d and d not in P.DOMAINS:
                raise FilterError(f"unknown domain {d}")
    return used


def filter_fits(source: Column, name: Column, value: Column) -> Column:
    """Whether validated() takes a filter, row by row."""
    names = F.create_map(*(x for s, ns in FILTERS.items() for x in (F.lit(s), F.array(*map(F.lit, ns)))))
    given = F.filter(F.split(value, ","), lambda v: v != "")
    known = F.when(name == "doc_type", F.array(*map(F.lit, T.DOC_TYPES))).when(name.isin("exclude_domain", "only_domain", "include_domain"), F.array(*map(F.lit, P.DOMAINS))).when(name == "prefer", F.array(*map(F.lit, ("prod", "tests", "docs"))))
    return (F.coalesce(value, F.lit("")) == "") | (F.coalesce(F.array_contains(names[source], name), F.lit(False)) & (known.isNull() | (F.size(F.array_except(given, known)) == 0)))


@dataclass
class Engine:
    """Tables below base, one folder a source, with the postings of their contents. encoder: texts to vectors of length one. feedback: by source, ids that are liked and unliked, in every search of it."""

    spark: SparkSession
    base: str
    encoder: E.Encoder = E.hashed_encoder
    feedback: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)

    def _at(self, source: str) -> str:
        return f"{self.base}/{source}"

    def versions(self, source: str) -> W.VersionedTable:
        return W.VersionedTable(self.spark, self._at(source))

    def table(self, source: str) -> DataFrame | None:
        return self.versions(source).read()

    def _publish(self, source: str, rows: DataFrame, key: list[str], clean: bool, changed: DataFrame | None = None) -> dict:
        """changed: keys (path) whose old chunks go; rows replace them. Vectors of unchanged chunks are kept.

        The new version is committed with its postings, unless another one came meanwhile: then it is made anew from that.
        """
        made = self.versions(source)
        for _ in range(W.MOST_TRIES):
            state = made.state()
            now = None if clean or state.schema is None else made.merged(state)
            try:
                after = made.replace(self._current(rows, now, key, changed), key, made_from=state.version, beside=lambda written: self._store(source, written))
            except W.Conflict:
                continue
            self._expire(source, made)
            return {"source": source, "chunks": made.merged(after).count()}
        raise W.Conflict(f"{source} changed {W.MOST_TRIES} times while it was indexed")

    def _current(self, rows: DataFrame, now: DataFrame | None, key: list[str], changed: DataFrame | None) -> DataFrame:
        """rows with vectors, those of equal content from now; and now's other rows if only some were changed."""
        if now is None:
            return E.encode_table(rows, "embed_text", self.encoder)
        same = now.select(*key, F.col("content").alias("_c"), F.col("dense").alias("_d"), F.col("sparse").alias("_s"))
        met = rows.join(same, key, "left")
        reuse = F.col("_c").eqNullSafe(F.col("content")) & F.col("_d").isNotNull()
        old = met.filter(reuse).withColumns({"dense": F.col("_d"), "sparse": F.col("_s")}).drop("_c", "_d", "_s")
        new = E.encode_table(met.filter(~reuse).drop("_c", "_d", "_s"), "embed_text", self.encoder)
        rows = old.unionByName(new)
        return rows if changed is None else C.without_keys(now, changed, "path").unionByName(rows.select(now.columns))

    def _store(self, source: str, written: DataFrame) -> dict:
        name = f"p_{uuid.uuid4().hex[:12]}"
        I.store(V.term_weights(written.select("id", F.col("content").alias("text")), totals=True), f"{self._at(source)}/{name}")
        return {"postings": name}

    def _expire(self, source: str, made: W.VersionedTable, keep: int = 2) -> None:
        """Versions before the last keep go, with their postings."""
        there = made.versions()
        old = {made.state(v).note.get("postings") for v in there[-keep - 2 : -keep]} - {made.state(v).note.get("postings") for v in there[-keep:]}
        for name in old - {None}:
            C.remove(self.spark, f"{self._at(source)}/{name}")
        made.expire(keep)

    def index(self, records: DataFrame, clean: bool = False, changed: DataFrame | None = None) -> dict:
        """Records (key, content with front matter) as chunks of vault records."""
        front, body = S.front_matter(F.col("content"))
        r = records.select("key", front.alias("front"), body.alias("body"))
        tags = S.front_list(F.col("front"), "tags")
        title = T.title(F.col("body"))
        meta = r.select("key", F.coalesce(S.front_field(F.col("front"), "type"), F.regexp_extract("key", "^([^/]+)/", 1)).alias("doc_type"), T.feature(tags).alias("feature"), S.front_field(F.col("front"), "date").alias("date"), tags.alias("tags"), S.front_list(F.col("front"), "related").alias("related"), F.when(title != "", title).otherwise(F.regexp_extract("key", "([^/]*)$", 1)).alias("title"), T.status(F.col("body")).alias("status"))
        chunks = K.chunk_records(r.select(F.col("key").alias("id"), F.trim("body").alias("content"))).withColumnRenamed("id", "key")
        rows = chunks.join(meta, "key").select(F.concat_ws("#c", "key", F.col("ordinal").cast("string")).alias("id"), F.col("key").alias("doc"), F.col("key").alias("path"), "ordinal", "content", "line_start", "line_end", "section", "passages", "doc_type", "feature", "date", "tags", "related", "title", "status", T.vault_input(F.col("title"), F.col("content")).alias("embed_text"))
        return self._publish("vault", rows, ["id"], clean, changed)

    def index_codebase(self, files: DataFrame, clean: bool = False, changed: DataFrame | None = None) -> dict:
        """Files (path, content as text) as code chunks."""
        fields = "id string, content string, line_start int, line_end int, node_type string, function_name string, class_name string"
        names = [f.split()[0] for f in fields.split(", ")]

        def run(batches):
            import pyarrow as pa

            for b in batches:
                rows = [(i, c) for i, (path, text, lang) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)) for c in K.code_chunks(text or "", path, lang)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in rows], pa.int64())), b.column(2).take(pa.array([i for i, _ in rows], pa.int64())), *(pa.array([c[n] for _, c in rows], pa.int32() if n.startswith("line") else pa.string()) for n in names)], names=["path", "language", *names])

        parsed = files.select("path", "content", S.parser(F.col("path"))["language"].alias("language"))
        rows = parsed.mapInArrow(run, f"path string, language string, {fields}")
        rows = rows.withColumns({"domain": P.classify_domain(F.col("path")), "embed_text": T.code_input(F.col("path"), F.col("class_name"), F.col("function_name"), F.col("content"))})
        return self._publish("codebase", rows, ["id"], clean, changed)

    def index_documents(self, units: DataFrame, clean: bool = False, changed: DataFrame | None = None) -> dict:
        """Extracted units (path, ordinal, text, title, section) as document chunks."""
        rows = units.filter("text is not null").select(T.fragment_id(F.col("path"), F.col("ordinal"), F.sha2("text", 256), F.lit(None).cast("string"), F.lit(0)).alias("id"), "path", "ordinal", F.col("text").alias("content"), "title", "section")
        return self._publish("document", rows.withColumn("embed_text", T.document_input(F.col("path"), F.col("title"), F.col("section"), F.col("content"))), ["id"], clean, changed)

    def index_all(self, **inputs: DataFrame) -> dict:
        """Each source's result or its error; one that fails leaves the others alone."""
        steps: dict[str, Callable] = {"vault": self.index, "codebase": self.index_codebase, "document": self.index_documents}
        out = {}
        for source, rows in inputs.items():
            try:
                out[source] = steps[source](rows)
            except Exception as e:  # noqa: BLE001  the outcome says it
                out[source] = {"source": source, "error": str(e)}
        return out

    def _filtered(self, source: str, filters: dict) -> DataFrame | None:
        rows = self.table(source)
        if rows is None:
            return None
        keep = F.lit(True)
        for name, value in filters.items():
            if name == "tag":
                keep = keep & (F.array_contains("tags", value) | F.array_contains("tags", f"#{value}"))
            elif name == "doc_type":
                keep = keep & F.col("doc_type").isin(*value.split(","))
            elif name == "path_scope":
                keep = keep & P.matches_any(F.col("path"), [value])
            elif name in ("include_paths", "exclude_paths"):
                keep = keep & (P.matches_any(F.col("path"), value) if name == "include_paths" else ~P.matches_any(F.col("path"), value))
            elif name in ("language", "path", "node_type", "function_name", "class_name", "feature", "date", "source_path", "title", "section", "extractor_id"):
                keep = keep & (F.col("path" if name == "source_path" else name) == value)
        if source == "codebase":
            policy = P.resolve_noise(exclude=filters.get("exclude_domain", "").split(","), only=filters.get("only_domain", "").split(","), include=filters.get("include_domain", "").split(","))
            domain = P.stored_domain(F.col("domain"), F.col("path"))
            keep = keep & ~domain.isin(*policy["hide"]) if policy["hide"] else keep
            keep = keep & domain.isin(*policy["only"]) if policy["only"] else keep
        return rows.filter(keep)

    def _page(self, source: str, query: str, k: int, filters: dict) -> tuple[DataFrame | None, dict]:
        parsed = self.spark.range(1).select(T.parse_query(F.lit(query)).alias("q")).first()["q"].asDict()
        text = parsed.pop("text")
        wanted = validated(source, {**{n: v for n, v in parsed.items() if v and n in FILTERS[source]}, **filters})
        rows = self._filtered(source, wanted)
        if rows is None:
            return None, wanted
        window = V.window_size(k, True, source == "codebase" and bool({"include_paths", "exclude_paths"} & set(wanted)), source == "codebase")
        counts = Counter(re.findall(r"[a-z0-9]+", text.lower()))
        terms = self.spark.createDataFrame([(0, t, 1 + math.log(n)) for t, n in counts.items()], "qid int, term string, q double")
        index = I.Index(self.spark, f"{self._at(source)}/{self.versions(source).state().note['postings']}")
        leg = V.hybrid(rows.select("id", F.col("dense").alias("vector")), self._dense_query(source, text), index, terms, window, filtered=bool(wanted) or source == "codebase")
        page = rows.join(F.broadcast(leg), "id").withColumn("pos", F.col("rank"))
        scores = R.lexical_score(terms, page.select("qid", "id", F.col("content").alias("text")))
        page = R.rerank(page.join(scores, ["qid", "id"], "left").withColumn("score", F.coalesce("rerank", F.lit(0.0))).drop("rerank"), F.col("score"), window)
        return page, wanted

    def _dense_query(self, source: str, text: str) -> DataFrame:
        """The query's vector, moved to what is liked and away from what isn't; ids that are gone don't count."""
        own = self.spark.createDataFrame([(0, [float(x) for x in self.encoder([text])[0]])], "qid int, vector array<double>")
        like, unlike = self.feedback.get(source, ((), ()))
        if not like and not unlike:
            return own.withColumnRenamed("vector", "query")
        rows = self.table(source)

        def vectors(ids) -> DataFrame:
            head = (F.col("doc").isin(list(ids)) & (F.col("ordinal") == 0)) if "doc" in rows.columns else F.lit(False)
            return rows.filter(F.col("id").isin(list(ids)) | head).select(F.lit(0).alias("qid"), F.col("dense").cast("array<double>").alias("vector"))

        return V.recommend(own.unionByName(vectors(like)), vectors(unlike))

    def search_vault(self, query: str, k: int = 5, **filters) -> DataFrame | None:
        """Drop navigation, group, links, intent, cap, status, limit, passages: in this order."""
        page, used = self._page("vault", query, k, filters)
        if page is None:
            return None
        page = R.group_documents(R.drop_navigational(page))
        edges = self.table("vault").select(F.col("doc").alias("src"), F.explode("related").alias("dst")).distinct()
        nodes = self.table("vault").filter("ordinal = 0").select(F.col("doc").alias("id"), "tags")
        feature = self.spark.range(1).select(T.query_filter(F.lit(query), "feature").alias("f")).first()["f"]
        page = page.withColumnRenamed("id", "chunk").withColumnRenamed("doc", "id")
        page = R.graph_nudge(page, edges, nodes, feature)
        page = R.status_filter(R.type_cap(R.intent_prior(page, R.intent_profile(used.get("intent")))), used.get("status", ""))
        page = page.filter(F.col("pos") <= k)
        texts = page.withColumns({"passages": F.transform("passages", lambda p: F.substring(F.col("content"), p["start"] + 1, p["end"] - p["start"])), "snippet": F.trim(F.substring("content", 1, 1200))})
        pairs = R.passage_pairs(texts).withColumn("_pair", F.concat_ws("\n", "id", F.col("ordinal").cast("string")))
        words = self.spark.createDataFrame([(0, t) for t in dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower()))], "qid int, term string")
        scores = R.lexical_score(words, pairs.select("qid", F.col("_pair").alias("id"), F.col("passage").alias("text")))
        scored = pairs.join(scores.withColumnsRenamed({"id": "_pair", "rerank": "passage_score"}), ["qid", "_pair"]).drop("_pair")
        return R.select_passages(texts, scored)

    def search_codebase(self, query: str, k: int = 5, **filters) -> DataFrame | None:
        page, used = self._page("codebase", query, k, filters)
        if page is None:
            return None
        page = page.withColumn("snippet", F.trim(F.substring("content", 1, 200)))
        page = R.prefer(R.demote_domains(page, sorted(P.resolve_noise()["demote"])), used.get("prefer"))
        return R.collapse_locales(page).filter(F.col("pos") <= k)

    def search_documents(self, query: str, k: int = 5, **filters) -> DataFrame | None:
        page, _ = self._page("document", query, k, filters)
        return None if page is None else page.filter(F.col("pos") <= k)

    def search_combined(self, query: str, k: int = 5) -> DataFrame | None:
        """The sources' own searches, merged by score, source, path and id; sources without a table add nothing."""
        pages = {"vault": self.search_vault(query, k), "codebase": self.search_codebase(query, k), "document": self.search_documents(query, k)}
        there = {n: p for n, p in pages.items() if p is not None}
        return R.combine(k, **there) if there else None

    def list_documents(self, doc_type: str | None = None) -> DataFrame | None:
        rows = self.table("vault")
        if rows is None:
            return None
        rows = C.one_per_document(rows)
        return rows.filter(F.col("doc_type") == doc_type) if doc_type else rows

    def status(self) -> dict[str, int]:
        return {s: (t.count() if (t := self.table(s)) is not None else 0) for s in SOURCES}

    def clean(self, source: str = "all") -> list[str]:
        gone = [s for s in SOURCES if source in ("all", s)]
        for s in gone:
            C.remove(self.spark, self._at(s))
        return gone

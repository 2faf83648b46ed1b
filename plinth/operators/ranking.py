"""Steps on ranked pages. A page is (qid, id, score, pos, ...): pos is the order so far, from 1, and breaks all ties, as sorts keep it.

Windows are by query; pages are bounded by the limit of their retrieval, so no window grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import paths as P
from plinth.functions.text import ACTIVE
from plinth.operators.retrieval import checked_broadcast

# Weights of record types and of decisions' statuses by intent.
INTENTS = {
    "orientation": {
        "type": {"adr": 1.0, "audit": 1.0, "research": 0.85, "reference": 0.85, "plan": 0.6, "exec": 0.4},
        "status": {"accepted": 1.0, "unknown": 1.0, "proposed": 0.6, "superseded": 0.3, "rejected": 0.3, "deprecated": 0.3},
    },
    "debugging": {"type": {"exec": 1.0, "audit": 0.9, "plan": 0.7, "research": 0.6, "reference": 0.6, "adr": 0.6}, "status": {}},
}
TYPE_CAP = 4
IN_LINK_STEP, IN_LINK_CAP, NEIGHBOUR_NUDGE = 0.005, 10, 0.03
PREFER_NUDGE, DEMOTE_PENALTY, LOCALE_WINDOW = 0.05, 0.3, 0.10
PASSAGES_PER_RESULT, PASSAGES_PER_PAGE = 12, 48
SOURCES = ("vault", "codebase", "document")


def reordered(page: DataFrame) -> DataFrame:
    """By score; equal ones keep their order."""
    return page.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pos")))


def renumbered(page: DataFrame) -> DataFrame:
    return page.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("pos")))


def rerank(page: DataFrame, score: Column, limit: int) -> DataFrame:
    """Score replaced, reordered and cut. score: any expression, among them a pandas UDF."""
    return reordered(page.withColumn("score", score)).filter(F.col("pos") <= limit)


def drop_navigational(page: DataFrame) -> DataFrame:
    return page.filter(F.col("doc_type") != "index")


def group_documents(page: DataFrame) -> DataFrame:
    """The best chunk of each document, with the passages of its runner-up after its own; no third chunk's."""
    by = Window.partitionBy("qid", "doc").orderBy(F.desc("score"), "pos")
    next_passages = F.lead("passages").over(by)
    best = page.withColumn("_next", next_passages).withColumn("_n", F.row_number().over(by)).filter("_n = 1")
    merged = best.withColumn("passages", F.concat("passages", F.coalesce("_next", F.array().cast(page.schema["passages"].dataType)))).drop("_n", "_next")
    return reordered(merged)


def link_graph(edges: DataFrame) -> DataFrame:
    """(id, in_links): distinct sources of links to each id. edges: (src, dst)."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("in_links"))


def related(edges: DataFrame) -> DataFrame:
    """(id, outgoing, incoming): sorted distinct ends of links, of ids that have any."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("outgoing"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("incoming"))
    empty = F.array().cast("array<string>")
    return out.join(into, "id", "full_outer").select("id", F.coalesce("outgoing", empty).alias("outgoing"), F.coalesce("incoming", empty).alias("incoming"))


def graph_nudge(page: DataFrame, edges: DataFrame, nodes: DataFrame, feature: str | None = None) -> DataFrame:
    """Scores rise by in-links, and where a neighbour either way has the feature's tag; results without a node stay. nodes: (id, tags)."""
    known = page.join(nodes.select("id", F.lit(True).alias("_node")), "id", "left").join(link_graph(edges), "id", "left")
    nudge = IN_LINK_STEP * F.least(F.coalesce("in_links", F.lit(0)), F.lit(IN_LINK_CAP))
    if feature:
        tagged = nodes.filter(F.array_contains("tags", f"#{feature}")).select(F.col("id").alias("end"))
        ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("end")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("end")))
        near = ends.join(tagged, "end", "left_semi").select("id").distinct().withColumn("_near", F.lit(True))
        known = known.join(near, "id", "left")
        nudge = nudge + F.when(F.col("_near"), NEIGHBOUR_NUDGE).otherwise(0.0)
    return reordered(known.withColumn("score", F.when(F.col("_node"), F.col("score") + nudge).otherwise(F.col("score"))).select(page.columns))


def intent_profile(name: str | None) -> dict:
    """Weights by intent; none given is orientation, debug is debugging, an unknown one weighs nothing."""
    return INTENTS.get({"": "orientation", "debug": "debugging"}.get((name or "").strip().lower(), (name or "").strip().lower()), {})


def weight_of(values: dict[str, float], key: Column) -> Column:
    out = F.lit(1.0)
    for k, w in values.items():
        out = F.when(key == k, w).otherwise(out)
    return out


def intent_prior(page: DataFrame, profile: dict) -> DataFrame:
    """Scores times the weight of the type, and of the status for decisions."""
    if not profile:
        return page
    status = F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("unknown"))
    weight = weight_of(profile["type"], F.col("doc_type")) * F.when(F.col("doc_type") == "adr", weight_of(profile["status"], status)).otherwise(1.0)
    return reordered(page.withColumn("score", F.col("score") * weight))


def type_cap(page: DataFrame, cap: int = TYPE_CAP) -> DataFrame:
    if cap <= 0:
        return page
    nth = F.row_number().over(Window.partitionBy("qid", "doc_type").orderBy("pos"))
    return renumbered(page.withColumn("_n", nth).filter(F.col("_n") <= cap).drop("_n"))


def status_filter(page: DataFrame, spec: str) -> DataFrame:
    """all or empty: everything; active: active decisions; else a list of statuses. Other records stay."""
    wanted = spec.strip().lower()
    if wanted in ("", "all"):
        return page
    names = ACTIVE if wanted == "active" else tuple(s.strip() for s in wanted.split(",") if s.strip())
    return renumbered(page.filter((F.col("doc_type") != "adr") | F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("unknown")).isin(*names)))


def demote_domains(page: DataFrame, demoted: list[str], penalty: float = DEMOTE_PENALTY) -> DataFrame:
    """By the path's domain, not the stored one."""
    if penalty <= 0 or not demoted:
        return page
    return reordered(page.withColumn("score", F.when(P.classify_domain(F.col("path")).isin(*demoted), F.col("score") - penalty).otherwise(F.col("score"))))


def prefer(page: DataFrame, category: str | None) -> DataFrame:
    if category not in ("prod", "tests", "docs"):
        return page
    return reordered(page.withColumn("score", F.col("score") + F.when(P.chunk_category(F.col("path")) == category, PREFER_NUDGE).otherwise(-PREFER_NUDGE)))


def collapse_locales(page: DataFrame, window: float = LOCALE_WINDOW) -> DataFrame:
    """Of locale variants the best stays, with the paths of those within the window, which go; others stay."""
    by = Window.partitionBy("qid", "_key").orderBy(F.desc("score"), "pos")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = page.withColumn("_key", P.locale_key(F.col("path")))
    marked = marked.withColumn("_key", F.coalesce("_key", F.concat(F.lit("\u0000"), F.col("pos").cast("string"))))
    marked = marked.withColumns({"_n": F.row_number().over(by), "_best": F.first("score").over(by)})
    near = (F.col("_n") > 1) & (F.col("_best") - F.col("score") <= window)
    marked = marked.withColumn("_near", near).withColumn("variants", F.collect_list(F.when(F.col("_near"), F.col("path"))).over(whole))
    tag = F.concat(F.lit("[locale variants: "), F.array_join("variants", ", "), F.lit("]"))
    shown = F.when((F.col("_n") == 1) & (F.size("variants") > 0), F.when(F.coalesce("snippet", F.lit("")) == "", tag).otherwise(F.concat("snippet", F.lit(" "), tag))).otherwise(F.col("snippet"))
    return renumbered(marked.withColumn("snippet", shown).filter("not _near").drop("_key", "_n", "_best", "_near", "variants"))


def passage_pairs(page: DataFrame) -> DataFrame:
    """(qid, id, pos, ordinal, passage) that a page scores: results with two passages or more, whole, in order, until one overruns the budget."""
    n = F.least(F.size("passages"), F.lit(PASSAGES_PER_RESULT))
    rows = page.select("qid", "id", "pos", "passages", F.when(n >= 2, n).otherwise(0).alias("n"))
    by = Window.partitionBy("qid").orderBy("pos")
    total = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = rows.withColumn("_over", F.max((total > PASSAGES_PER_PAGE).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return taken.filter("n > 0 and _over = 0").select("qid", "id", "pos", F.posexplode(F.slice("passages", 1, PASSAGES_PER_RESULT)).alias("ordinal", "passage"))


def select_passages(page: DataFrame, scored: DataFrame) -> DataFrame:
    """page with its best passage as snippet: of (qid, id, ordinal, passage, passage_score) the highest score, the earlier of equals; without one the first passage."""
    best = scored.groupBy("qid", "id").agg(F.max_by("passage", F.struct("passage_score", -F.col("ordinal"))).alias("_best"))
    return page.join(best, ["qid", "id"], "left").withColumn("snippet", F.coalesce("_best", F.try_element_at("passages", F.lit(1)), "snippet")).drop("_best")


def combine(limit: int, **pages: DataFrame) -> DataFrame:
    """Pages of sources as one: by score, source (SOURCES' order), path and id."""
    union = None
    for source, page in pages.items():
        own = page.select("qid", F.lit(source).alias("source"), F.col("id").cast("string").alias("id"), "path", "score")
        union = own if union is None else union.unionByName(own)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")), "path", "id")
    return union.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= max(0, limit))


def collapse_report(page: DataFrame, least: int = 5) -> DataFrame:
    """(qid, n, path): pages of at least least results that all have one path."""
    return page.groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("path").alias("_d"), F.min("path").alias("path")).filter((F.col("n") >= least) & (F.col("_d") == 1)).drop("_d")


def lexical_score(query_terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, id, rerank): the share of a query's terms that a text, read whole, has; the default where no model is given. texts: (qid, id, text)."""
    wanted = checked_broadcast(query_terms.groupBy("qid").agg(F.collect_set("term").alias("wanted")))
    own = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)
    return texts.join(wanted, "qid").select("qid", "id", (F.size(F.array_intersect(own, "wanted")) / F.greatest(F.size("wanted"), F.lit(1))).alias("rerank"))

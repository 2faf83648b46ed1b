"""Retrieval queries: dense, sparse and fused legs, feedback, and searches whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import codes as Q
from plinth.operators import postings as P
from plinth.operators import ranking as K
from plinth.operators import retrieval as R
from plinth.plans.base import VAULT_SQL, Plans, literal, literal_sql, table, vault, written
from plinth.sources import files as S

plans = Plans()
QUERIES, SQL = plans.queries, plans.sql

#: Each vector whose id is divisible by this is a query; of the benchmark all items are.
EVERY = 100


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).filter(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), F.col("vector").alias("query"))


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


def query_terms(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return R.term_weights(b).select(F.col("id").alias("qid"), "term", F.col("weight").alias("q"))


_stored: dict[tuple, P.Index] = {}


def index(spark, sf_dir, anew: bool = False) -> P.Index:
    """The documents' stored postings, with the language as payload; written once a session and state of the files, as an index is."""
    source = table(spark, sf_dir, "documents")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    changed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()
    key = (spark.sparkContext.applicationId, sf_dir, changed, tuple(sorted(source.inputFiles())))
    if anew or key not in _stored:
        _stored[key] = P.store(R.term_weights(texts(spark, sf_dir), totals=True), f"{S.scratch(spark)}/postings")
    return _stored[key]


@plans.add("index_postings", "select term, count(*) as texts, round(sum(weight), 6) as weight from (select doc_id, term, 1 + ln(count(*)) as weight from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) group by doc_id, term) group by term")
def indexed(spark, sf_dir):
    """The stored postings, written anew, by term."""
    return index(spark, sf_dir, anew=True).postings().groupBy("term").agg(F.count("*").alias("texts"), F.round(F.sum("weight"), 6).alias("weight"))


_COS = "round(list_dot_product(v.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 6)"


def dense_sql(limit: int, where: str = "true") -> str:
    return f"(select * from (select q.vec_id as qid, v.vec_id as id, {_COS} as score, row_number() over (partition by q.vec_id order by {_COS} desc, v.vec_id) as rank from embeddings v, embeddings q where q.vec_id % {EVERY} = 0 and {where}) where rank <= {limit})"


def terms_sql(source: str, key: str) -> str:
    return f"(select {key} as id, term, 1 + ln(count(*)) as weight from (select {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from {source}) group by {key}, term)"


def sparse_sql(limit: int, where: str = "true") -> str:
    q = terms_sql("benchmark", "item_id")
    return f"(select *, row_number() over (partition by qid order by score desc, id) as rank from (select q.id as qid, p.id as id, round(sum(p.weight * q.weight), 6) as score from {terms_sql(f'(select * from documents where {where})', 'doc_id')} p join {q} q on p.term = q.term group by q.id, p.id) qualify rank <= {limit})"


@plans.add("retrieve_sparse_topk", f"select qid, id, score, rank from {sparse_sql(10)}")
def sparse_topk(spark, sf_dir):
    return index(spark, sf_dir).top(query_terms(spark, sf_dir), 10, 6)


@plans.add("i06_dense_knn", f"select qid, id, score, rank from {dense_sql(20)}")
def dense(spark, sf_dir):
    return R.dense_leg(vectors(spark, sf_dir), query_vectors(spark, sf_dir), 20, 6)


@plans.add("a24_i06_coded_knn")
def coded(spark, sf_dir):
    """i06's neighbours by an index of codes: not all of them (tests measure how many), with i06's own scores."""
    made = Q.build(vectors(spark, sf_dir).select("id", "vector"), f"{S.scratch(spark)}/codes")
    return made.search(vectors(spark, sf_dir).select("id", "vector"), query_vectors(spark, sf_dir), 20, 6)


@plans.add("i07_sparse_dot_filtered", f"select qid, id, score, rank from {sparse_sql(20, chr(39) + 'fr' + chr(39) + ' = lang')}")
def sparse(spark, sf_dir):
    return index(spark, sf_dir).top(query_terms(spark, sf_dir), 20, 6, where=F.col("lang") == "fr")


def fused_sql(limit: int, dense_where: str = "true", sparse_where: str = "true") -> str:
    legs = f"select qid, id, rank from {dense_sql(4 * limit, dense_where)} union all select qid, id, rank from {sparse_sql(4 * limit, sparse_where)}"
    return f"(select *, row_number() over (partition by qid order by score desc, id) as rank from (select qid, id, round(sum(1.0::double / (60 + rank)), 10) as score from ({legs}) group by qid, id) qualify rank <= {limit})"


@plans.add("c01_d01_i08_hybrid_rrf", f"select qid, id, score, rank from {fused_sql(10)}")
def fused(spark, sf_dir):
    return R.hybrid(vectors(spark, sf_dir), query_vectors(spark, sf_dir), index(spark, sf_dir), query_terms(spark, sf_dir), 10, places=6)


@plans.add("b02_i12_i13_filtered_hybrid", f"select qid, id, score, rank from {fused_sql(8, 'v.label in (1, 3)', 'doc_id in (select vec_id from embeddings where label in (1, 3))')}")
def filtered(spark, sf_dir):
    return R.hybrid(vectors(spark, sf_dir), query_vectors(spark, sf_dir), index(spark, sf_dir), query_terms(spark, sf_dir), 8, keep=F.col("label").isin(1, 3), places=6)


@plans.add("d01_single_leg", f"select qid, id, score, rank from {dense_sql(5, 'v.label = 2')}")
def single(spark, sf_dir):
    return R.hybrid(vectors(spark, sf_dir), query_vectors(spark, sf_dir), None, None, 5, keep=F.col("label") == 2, places=6).filter("rank <= 5")


_MEAN = "(select qid, list(x order by i) as m from (select qid, i, avg(x) as x from (select qid, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from {}) group by qid, i) group by qid)"
_POS = "(select vec_id // 100 as qid, embedding from embeddings where vec_id % 4 < 3)"
_NEG = "(select vec_id // 100 as qid, embedding from embeddings where vec_id % 4 = 3 and vec_id % 200 < 100)"


@plans.add("i09_recommend_vector", f"select p.qid, list_transform(list_zip(p.m, n.m), lambda z: round(case when n.m is null then z[1] else 2 * z[1] - z[2] end, 6)) as query from {_MEAN.format(_POS)} p left join {_MEAN.format(_NEG)} n on p.qid = n.qid")
def recommended(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.floor(F.col("id") / 100).alias("qid"), "vector", "id")
    out = R.recommend(v.filter("id % 4 < 3"), v.filter("id % 4 = 3 and id % 200 < 100"))
    return out.select("qid", F.transform("query", lambda x: R.rounded(x, 6)).alias("query"))


@plans.add("i10_live_anchors", "select q.vec_id as qid, a.id from embeddings q, (select unnest([1, 7, 100000000]) as id) a where a.id in (select vec_id from embeddings)")
def anchors(spark, sf_dir):
    q = vectors(spark, sf_dir).select(F.col("id").alias("qid"), F.explode(F.array(*(F.lit(x).cast("long") for x in (1, 7, 100000000)))).alias("id"))
    return R.live_anchors(q, vectors(spark, sf_dir)).select("qid", "id")


@plans.add("i11_a31_head_point", "select doc_id::varchar as doc, case when doc_id % 3 = 0 then doc_id when doc_id % 3 = 1 then -doc_id end as point from documents")
def heads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("doc"))
    points = d.filter("doc_id % 3 = 0").select(F.concat("doc", F.lit("#c0")).alias("key"), F.col("doc_id").alias("point")).unionByName(d.filter("doc_id % 3 <= 1").select(F.col("doc").alias("key"), (-F.col("doc_id")).alias("point")))
    return R.head_point(d.select("doc"), points)


@plans.add("i14_points_to_rows", f"select l.qid, d.doc_id as id, d.source, l.score from {sparse_sql(10)} l join documents d on d.doc_id = l.id")
def rows_of_points(spark, sf_dir):
    leg = R.leg_side(sparse_topk(spark, sf_dir), query_terms(spark, sf_dir), 10)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source").join(leg, "id").select("qid", "id", "source", "score")


@plans.add("f08_f09_windows", "select distinct k, greatest(4 * k, 20) as window_, greatest(4 * k, least(64, greatest(4 * k, 6 * k, 32)), 20) as candidates, greatest(10 * k, 50) as code from (select l_linenumber * l_quantity::int as k from lineitem)")
def windows(spark, sf_dir):
    k = F.col("k")
    sizes = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * F.col("l_quantity").cast("int")).alias("k")).distinct()
    return sizes.select("k", R.window_size(k, True).alias("window_"), R.candidate_limit(k, R.window_size(k, True)).alias("candidates"), R.window_size(k, True, True, True).alias("code"))


@plans.add("f01_growing_window", f"""select qid, min(w) as taken from (select qid, w, there, count(*) filter (where lang = 'fr' and rank <= w) as found from (select *, count(*) over (partition by qid) as there from (select l.*, d.lang from {sparse_sql(200)} l join documents d on d.doc_id = l.id)),
  lateral (select unnest([10, least(20, greatest(there, 10)), least(40, greatest(there, 10)), least(80, greatest(there, 10)), least(160, greatest(there, 10)), least(320, greatest(there, 10)), least(500, greatest(there, 10))]) as w) group by qid, w, there) where found >= 5 or w >= there group by qid""")
def growing(spark, sf_dir):
    """How far each item's window grows until five French texts are in it."""
    leg = index(spark, sf_dir).top(query_terms(spark, sf_dir), 200, 6)
    page = texts(spark, sf_dir).select("id", "lang").join(leg, "id")
    return R.grown_windows(page.select("qid", "rank", (F.col("lang") == "fr").alias("fits")), 10, 5)


def vault_page(spark, sf_dir, limit: int = 40):
    """The sparse leg over records as a page: two chunks for each document (even and odd ids are one)."""
    leg = R.leg_side(sparse_leg_of(spark, sf_dir, limit), query_terms(spark, sf_dir), limit)
    page = vault(spark, sf_dir).join(leg, "id")
    pieces = F.transform(F.sequence(F.lit(1), (F.col("id") % 4 + 1).cast("int")), lambda i: F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("-"), i.cast("string")))
    # A page has limit rows a query; the steps after it read it more than once.
    return written(page.select("qid", "id", F.floor(F.col("id") / 2).alias("doc"), F.round(F.col("score") / 100, 4).alias("score"), F.col("rank").alias("pos"), "doc_type", "status", "path", "tags", F.substring("content", 1, 20).alias("snippet"), pieces.alias("passages")), "page")


def sparse_leg_of(spark, sf_dir, limit):
    return index(spark, sf_dir).top(query_terms(spark, sf_dir), limit, 6)


PAGE_SQL = f"""(select l.qid, v.id, v.id // 2 as doc, round(l.score / 100, 4) as score, l.rank as pos, v.doc_type, v.status, v.path, v.tags, substr(v.content, 1, 20) as snippet,
  list_transform(range(1, (v.id % 4 + 2)::int), lambda i: 'p' || v.id || '-' || i) as passages from {sparse_sql(40)} l join {VAULT_SQL} v on v.id = l.id)"""


def _again(inner: str, score: str = "score") -> str:
    return f"(select * exclude (score, pos), round({score}, 8) as score, row_number() over (partition by qid order by round({score}, 8) desc, pos) as pos from {inner})"


GROUP_SQL = f"""(select * exclude (passages, nxt, n), list_concat(passages, coalesce(nxt, [])) as passages from (select *, lead(passages) over w as nxt, row_number() over w as n from {PAGE_SQL} window w as (partition by qid, doc order by score desc, pos)) where n = 1)"""


def _out(df):
    return df.select("qid", "id", F.round("score", 6).alias("score"), "pos")


def _out_sql(inner: str) -> str:
    return f"select qid, id, round(score, 6) as score, pos from {inner}"


@plans.add("d02_group_chunks_by_document", f"select qid, id, array_to_string(passages, ',') as passages, round(score, 6) as score, pos from {_again(GROUP_SQL)}")
def grouped(spark, sf_dir):
    g = K.group_documents(vault_page(spark, sf_dir))
    return g.select("qid", "id", F.array_join("passages", ",").alias("passages"), F.round("score", 6).alias("score"), "pos")


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), F.explode(F.array((F.col("doc_id") * 7 + 3) % 1000, (F.col("doc_id") * F.col("doc_id")) % 1000)).alias("dst"))


EDGES_SQL = "(select doc_id as src, unnest([(doc_id * 7 + 3) % 1000, (doc_id * doc_id) % 1000]) as dst from documents)"


@plans.add("c04_f07_rerank_with_graph", _out_sql(_again(f"""(select p.* exclude (score), p.score + 0.005 * least(coalesce(g.n, 0), 10) + case when x.id is not null then 0.03 else 0 end as score from {PAGE_SQL} p
  left join (select dst as id, count(distinct src) as n from {EDGES_SQL} group by dst) g on g.id = p.id
  left join (select distinct e.a as id from (select src as a, dst as b from {EDGES_SQL} union all select dst, src from {EDGES_SQL}) e join {VAULT_SQL} v on v.id = e.b where list_contains(v.tags, '#src3')) x on x.id = p.id)""")))
def graphed(spark, sf_dir):
    page = vault_page(spark, sf_dir)
    out = K.graph_nudge(page, _edges(spark, sf_dir), vault(spark, sf_dir).select("id", "tags"), "src3")
    return _out(K.reordered(out.withColumn("score", F.round("score", 8)).drop("pos").join(page.select("qid", "id", "pos"), ["qid", "id"])))


@plans.add("i27_get_related", f"select coalesce(a.id, b.id) as id, coalesce(outgoing, []) as outgoing, coalesce(incoming, []) as incoming from (select src::varchar as id, list_sort(list(distinct dst::varchar)) as outgoing from {EDGES_SQL} group by src) a full outer join (select dst::varchar as id, list_sort(list(distinct src::varchar)) as incoming from {EDGES_SQL} group by dst) b on a.id = b.id")
def related(spark, sf_dir):
    return K.related(_edges(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")))


def _case(values: dict, key: str) -> str:
    return "case " + key + " " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " else 1.0 end"


def _weight_sql(profile: dict) -> str:
    status = _case(profile["status"], "coalesce(nullif(status, ''), 'unknown')") if profile["status"] else "1.0"
    return f"({_case(profile['type'], 'doc_type')}) * (case when doc_type = 'adr' then {status} else 1.0 end)"


_ORIENT = f"(select * exclude (score), score * ({_weight_sql(K.INTENTS['orientation'])})::double as score from {PAGE_SQL})"
_DEBUG = f"(select * exclude (score), score * ({_weight_sql(K.INTENTS['debugging'])})::double as score from {PAGE_SQL})"


def _exact(step, page):
    """step's scores rounded before they are ordered, as in the SQL."""
    out = step(page).withColumn("score", F.round("score", 8)).drop("pos").join(page.select("qid", "id", "pos"), ["qid", "id"])
    return K.reordered(out)


@plans.add("f06_i19_i20_i21_intent_orientation", _out_sql(_again(_ORIENT)))
def orientation(spark, sf_dir):
    return _out(_exact(lambda p: K.intent_prior(p, K.intent_profile(None)), vault_page(spark, sf_dir)))


@plans.add("f06_i20_intent_debugging", _out_sql(_again(_DEBUG)))
def debugging(spark, sf_dir):
    return _out(_exact(lambda p: K.intent_prior(p, K.intent_profile("debug")), vault_page(spark, sf_dir)))


@plans.add("e02_type_cap", f"select qid, id, row_number() over (partition by qid order by pos) as pos from (select *, row_number() over (partition by qid, doc_type order by pos) as n from {PAGE_SQL}) where n <= 4")
def capped(spark, sf_dir):
    return K.type_cap(vault_page(spark, sf_dir)).select("qid", "id", "pos")


@plans.add("b17_status_filter", f"select 'active' as spec, qid, id, row_number() over (partition by qid order by pos) as pos from {PAGE_SQL} where doc_type <> 'adr' or coalesce(nullif(status, ''), 'unknown') in ('accepted', 'unknown') union all select 'list', qid, id, row_number() over (partition by qid order by pos) from {PAGE_SQL} where doc_type <> 'adr' or coalesce(nullif(status, ''), 'unknown') in ('proposed', 'superseded')")
def by_status(spark, sf_dir):
    page = vault_page(spark, sf_dir)
    both = [K.status_filter(page, s).select(F.lit(n).alias("spec"), "qid", "id", "pos") for n, s in (("active", "Active"), ("list", "proposed, superseded"))]
    return both[0].unionByName(both[1])


@plans.add("b18_navigational_drop", f"select qid, id from {PAGE_SQL} where doc_type <> 'exec'")
def navigational(spark, sf_dir):
    page = vault_page(spark, sf_dir).withColumn("doc_type", F.when(F.col("doc_type") == "exec", "index").otherwise(F.col("doc_type")))
    return K.drop_navigational(page).select("qid", "id")


_CODE_PATH = "['src/a', 'tests/a', 'docs/a', 'vendor/a', 'locales/en/m', 'i18n/de/m', 'i18n/fr/m', 'lang/es'][(id % 8 + 1)::int] || (case when id % 8 >= 4 then '.po' else id || '.py' end)"


def code_page(spark, sf_dir, page=None):
    names = F.array(*map(F.lit, ("src/a", "tests/a", "docs/a", "vendor/a", "locales/en/m", "i18n/de/m", "i18n/fr/m", "lang/es")))
    tail = F.when(F.col("id") % 8 >= 4, ".po").otherwise(F.concat(F.col("id").cast("string"), F.lit(".py")))
    return (page if page is not None else vault_page(spark, sf_dir)).withColumn("path", F.concat(F.element_at(names, (F.col("id") % 8 + 1).cast("int")), tail))


CODE_SQL = f"(select * exclude (path), {_CODE_PATH} as path from {PAGE_SQL})"


@plans.add("f04_domain_demotion", _out_sql(_again(f"(select * exclude (score), case when id % 8 in (1, 2, 3, 4, 5, 6, 7) then score - 0.3 else score end as score from {CODE_SQL})")))
def demoted(spark, sf_dir):
    return _out(_exact(lambda p: K.demote_domains(p, ["tests", "docs", "locale", "vendored"]), code_page(spark, sf_dir)))


@plans.add("f05_prefer_nudge", _out_sql(_again(f"(select * exclude (score), case when id % 8 = 1 then score + 0.05 else score - 0.05 end as score from {CODE_SQL})")))
def preferred(spark, sf_dir):
    return _out(_exact(lambda p: K.prefer(p, "tests"), code_page(spark, sf_dir)))


@plans.add("e03_e04_locale_collapse", f"""select qid, id, array_to_string(list_sort(v), ',') as variants, row_number() over (partition by qid order by pos) as pos from (
  select *, list(path) filter (where near) over (partition by qid, key) as v0, case when n = 1 then coalesce(list(path) filter (where near) over (partition by qid, key), []) else [] end as v from (
    select *, n > 1 and best - score <= 0.10 as near from (
      select *, row_number() over w as n, first(score) over w as best from (select *, case when id % 8 in (5, 6) then 'i18n/*/m.po' when id % 8 = 4 then 'locales/*/m.po' when id % 8 = 7 then 'lang/*.po' else 'pos' || pos end as key from {CODE_SQL})
      window w as (partition by qid, key order by score desc, pos)))) where not near""")
def collapsed(spark, sf_dir):
    out = K.collapse_locales(code_page(spark, sf_dir).withColumn("snippet", F.lit("")))
    found = F.regexp_extract("snippet", r"variants: (.*)\]$", 1)
    return out.select("qid", "id", F.array_join(F.sort_array(F.split(found, ", ")), ",").alias("variants"), "pos")


@plans.add("e05_passage_pairs", f"""select qid, id, pos, unnest(passages) as passage, generate_subscripts(passages, 1)::int - 1 as ordinal from (
  select *, max((total > 48)::int) over (partition by qid order by pos) as over_ from (select *, sum(n) over (partition by qid order by pos) as total from (select *, case when len(passages) >= 2 then least(len(passages), 12) else 0 end as n from {PAGE_SQL}))) where n > 0 and over_ = 0""")
def pairs(spark, sf_dir):
    return K.passage_pairs(vault_page(spark, sf_dir)).select("qid", "id", "pos", "passage", "ordinal")


@plans.add("e06_select_passages", f"""select p.qid, p.id, coalesce(max_by(s.passage, [length(s.passage), -s.ordinal]), any_value(p.passages)[1]) as snippet from {PAGE_SQL} p left join (select * from ({SQL['e05_passage_pairs']})) s on p.qid = s.qid and p.id = s.id group by p.qid, p.id""")
def best_passages(spark, sf_dir):
    page = vault_page(spark, sf_dir)
    scored = K.passage_pairs(page).withColumn("passage_score", F.length("passage"))
    return K.select_passages(page, scored).select("qid", "id", "snippet")


_DOCS = f"(select qid, id, score, path from {PAGE_SQL} where id % 3 = 0)"


@plans.add("f03_g07_d17_combined", f"""select qid, source, id, score, pos from (select *, row_number() over (partition by qid order by score desc, list_position(['vault','codebase','document'], source), path, id) as pos from (
  select qid, 'vault' as source, id::varchar as id, score, path from {PAGE_SQL} union all select qid, 'codebase', id::varchar, score, path from {CODE_SQL} union all select qid, 'document', id::varchar, score, path from {_DOCS})) where pos <= 15""")
def combined(spark, sf_dir):
    page = vault_page(spark, sf_dir)
    return K.combine(15, vault=page, codebase=code_page(spark, sf_dir, page), document=page.filter("id % 3 = 0")).select("qid", "source", "id", "score", "pos")


@plans.add("g06_combined_reranked", f"""select qid, source, id, pos from (select *, row_number() over (partition by qid order by r desc, pos) as pos2 from (select *, length(path)::double as r from (select *, row_number() over (partition by qid order by score desc, list_position(['vault','codebase','document'], source), path, id) as pos from (
  select qid, 'vault' as source, id::varchar as id, score, path from {PAGE_SQL} union all select qid, 'codebase', id::varchar, score, path from {CODE_SQL})) where pos <= 20)) t(qid, source, id, score, path, pos0, r, pos) where pos <= 10""")
def combined_again(spark, sf_dir):
    page = vault_page(spark, sf_dir)
    union = K.combine(20, vault=page, codebase=code_page(spark, sf_dir, page))
    return K.rerank(union, F.length("path").cast("double"), 10).select("qid", "source", "id", "pos")


@plans.add("d11_result_collapse", f"select qid, count(*) as n, min(doc_type) as path from {PAGE_SQL} where doc_type = 'plan' group by qid having count(*) >= 5")
def collapse(spark, sf_dir):
    page = vault_page(spark, sf_dir).filter("doc_type = 'plan'").withColumn("path", F.col("doc_type"))
    return K.collapse_report(page)


@plans.add("i18_f02_lexical_rerank", f"""select qid, id, pos from (select p.qid, p.id, row_number() over (partition by p.qid order by len(list_intersect(list_distinct(regexp_extract_all(lower(v.content), '[a-z0-9]+')), w.terms))::double / len(w.terms) desc, p.pos) as pos
  from {PAGE_SQL} p join {VAULT_SQL} v on v.id = p.id join (select item_id as qid, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as terms from benchmark) w on w.qid = p.qid) where pos <= 10""")
def lexical(spark, sf_dir):
    page = vault_page(spark, sf_dir)
    body = page.select("qid", "id").join(vault(spark, sf_dir).select("id", F.col("content").alias("text")), "id")
    scores = K.lexical_score(query_terms(spark, sf_dir), body)
    return K.rerank(page.join(scores, ["qid", "id"]), F.col("rerank"), 10).select("qid", "id", "pos")


_CHAIN = f"""(select *, row_number() over (partition by qid order by pos) as pos3 from (select *, row_number() over (partition by qid, doc_type order by pos) as n from {_again(f"(select * exclude (score), score * ({_weight_sql(K.INTENTS['orientation'])})::double as score from {_again(GROUP_SQL)} t)")}) where n <= 4 and (doc_type <> 'adr' or coalesce(nullif(status, ''), 'unknown') in ('accepted', 'unknown')))"""


@plans.add("i15_n05_search_vault", f"select qid, id, round(score, 6) as score, pos3 as pos from {_CHAIN} where pos3 <= 10")
def search_vault(spark, sf_dir):
    """Group, intent prior, cap, status filter and limit, in this order: the cap comes before the filter."""
    page = vault_page(spark, sf_dir)
    page = K.intent_prior(K.group_documents(K.drop_navigational(page)), K.intent_profile("orientation"))
    return _out(K.status_filter(K.type_cap(page), "active").filter("pos <= 10"))


@plans.add("i16_n06_search_codebase", f"""select qid, id, row_number() over (partition by qid order by pos) as pos from {_again(f"(select * exclude (score), case when id % 8 <> 0 then score - 0.3 else score end as score from {CODE_SQL} where not (path glob 'vendor/*'))")} where id % 8 < 4 qualify row_number() over (partition by qid order by pos) <= 5""")
def search_code(spark, sf_dir):
    from plinth.functions.paths import path_filter

    page = code_page(spark, sf_dir).filter(path_filter(F.col("path"), exclude=["vendor"]))
    page = _exact(lambda p: K.demote_domains(p, ["tests", "docs", "locale", "vendored"]), page).filter("id % 8 < 4")
    return K.renumbered(page).filter("pos <= 5").select("qid", "id", "pos")


@plans.add("i17_n07_search_documents", f"select qid, id, row_number() over (partition by qid order by score desc, p.pos) as pos from {PAGE_SQL} p where id % 3 = 0 qualify row_number() over (partition by qid order by score desc, p.pos) <= 5")
def search_documents(spark, sf_dir):
    return K.reordered(vault_page(spark, sf_dir).filter("id % 3 = 0")).filter("pos <= 5").select("qid", "id", "pos")


@plans.add("b20_b21_b22_map_results", "select doc_id as id, trim(substr(text, 1, 200)) as snippet, trim(substr(text, 1, 1200)) = trim(substr(text, 1, 200)) as short from documents")
def mapped(spark, sf_dir):
    def cut(n):
        return F.trim(F.substring("text", 1, n))

    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), cut(200).alias("snippet"), (cut(1200) == cut(200)).alias("short"))

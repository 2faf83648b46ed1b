"""Extraction, stored filters, judging, scopes, schemas and the engine itself, over the tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from plinth.functions import chunk as K
from plinth.functions import encode as E
from plinth.functions import paths as P
from plinth.functions import text as T
from plinth.operators import catalog as C
from plinth.operators import judge as J
from plinth.operators import retrieval as R
from plinth.operators import schema as M
from plinth.plans.base import VAULT_SQL, Plans, literal, literal_sql, table, vault
from plinth.sources import files as S
from plinth.sources import preprocess as X

plans = Plans()
QUERIES, SQL = plans.queries, plans.sql


@plans.add("a12_extra_ignores", "select doc_id, doc_id % 6 in (0, 2, 3, 5) as ignored from documents")
def ignores(spark, sf_dir):
    """Own rules come after those of the folders, for the documents as files of several places."""
    rules = S.ignore_rules([("", "*.tmp"), ("a", "!keep.tmp")], ["drafts/"])
    i = F.col("doc_id").cast("string")
    place = F.element_at(F.array(F.concat(F.lit("a/"), i, F.lit(".tmp")), F.concat(F.lit("a/"), i, F.lit("/keep.tmp")), F.concat(F.lit("drafts/"), i, F.lit(".md")), F.concat("source", F.lit("/drafts/"), i), F.concat(F.lit("src/"), i, F.lit(".py")), F.concat(F.lit(".git/"), i)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", S.is_ignored(place, rules).alias("ignored"))


@plans.add("a14_content_hash", "select doc_id, sha256(text) as digest, strlen(text) > 10485760 as over from documents")
def hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), (F.octet_length("text") > S.MAX_SOURCE_BYTES).alias("over"))


@plans.add("a15_document_chunks", "select doc_id, i as piece, md5(substr(t, i * 5888 + 1, 6144)) as digest from (select doc_id, t, unnest(range(0, (length(t) + 5887) // 5888)) as i from (select doc_id, replace(text, chr(13) || chr(10), chr(10)) as t from documents))")
def document_chunks(spark, sf_dir):
    plain = F.regexp_replace("text", "\r\n", "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.fixed_windows(plain, 6144, 256)).alias("piece", "chunk"))
    return d.select("doc_id", F.col("piece").cast("long").alias("piece"), F.md5("chunk").alias("digest"))


def _code(spark, sf_dir):
    """Documents as source files: every third is Python, every ninth of these broken."""
    body = F.concat(F.lit("import os\n\n\ndef f"), F.col("doc_id").cast("string"), F.lit("(x):\n    return '"), F.regexp_replace("text", r"[\n'\\]", " "), F.lit("'\n\n\nclass A:\n    def m(self):\n        return 1\n"), F.when(F.col("doc_id") % 9 == 0, "def (:\n").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, body).otherwise(F.col("text")).alias("content"), F.when(F.col("doc_id") % 3 == 0, "python").otherwise("text").alias("language"))


@plans.add("a16_a17_h06_h07_h08_h09_code_chunks", "select doc_id, doc_id % 3 = 0 and doc_id % 9 <> 0 as by_syntax, true as whole from documents")
def code_chunks(spark, sf_dir):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            tree, whole = [], []
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                chunks = K.code_chunks(text or "", "p", lang)
                tree.append(any(c["node_type"] for c in chunks))
                whole.append("".join("".join(c["content"].split()) for c in chunks) == "".join((text or "").split()) and all(c["line_start"] <= c["line_end"] for c in chunks))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tree), pa.array(whole)], names=["doc_id", "by_syntax", "whole"])

    return _code(spark, sf_dir).select("doc_id", "content", "language").mapInArrow(run, "doc_id long, by_syntax boolean, whole boolean")


def head_units(path, content):
    return {"schema_version": 1, "units": [{"text": content.decode()[:40], "title": path}, {"text": "end"}]}


RULES = [X.Rule("*", "upper", entry_point="plinth.plans.surface:head_units"), X.Rule("*", "cat", command=("cat",), on_error="passthrough")]


@plans.add("a18_a19_k01_k02_k03_k04_k05_extract", "select doc_id::varchar as path, 'ok' as state, 0 as ordinal, length(substr(coalesce(text, ''), 1, 40)) as n from documents where doc_id % 100 <> 1 union all select doc_id::varchar, 'ok', 1, 3 from documents where doc_id % 100 <> 1 union all select doc_id::varchar, 'passthrough', 0, null from documents where doc_id % 100 = 1")
def extracted(spark, sf_dir):
    """All documents by the function, but for those that go to a program of their own, which costs a process each."""
    d = table(spark, sf_dir, "documents").withColumn("rule", F.when(F.col("doc_id") % 100 == 1, "cat").otherwise("upper"))
    out = X.extract(d.select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), "rule"), RULES, {X.policy_digest(RULES)})
    return out.select("path", "state", "ordinal", F.when(F.col("state") == "ok", F.length("text")).alias("n"))


BATCHED = [X.Rule("*", "batch", command=("python3", "-c", "import json,sys; print(json.dumps([{'path': x['path'], 'schema_version': 1, 'text': x['text'][:5]} for x in json.load(sys.stdin) if not x['path'].endswith('7')]))"), batch=True)]


@plans.add("a20_extract_batches", "select item_id::varchar as path, case when item_id % 10 = 7 then 'skipped' else 'ok' end as state, case when item_id % 10 <> 7 then substr(text, 1, 5) end as text from benchmark")
def batches(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"), F.lit("batch").alias("rule"))
    return X.extract_batches(S.batches(b), BATCHED, {X.policy_digest(BATCHED)}).select("path", "state", "text")


@plans.add("a25_indexed_layout", "select o_orderkey from orders where o_orderstatus = 'F' and o_custkey between 10 and 20")
def layout(spark, sf_dir):
    """A table that is parted by a keyword and sorted by a number: both filters reach the files."""
    path = f"{S.scratch(spark)}/parted"
    table(spark, sf_dir, "orders").repartition("o_orderstatus").sortWithinPartitions("o_custkey").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).filter("o_orderstatus = 'F' and o_custkey between 10 and 20").select("o_orderkey")


@plans.add("b03_b04_b05_stored_filters", f"select id from {VAULT_SQL} where lang = 'en' and source = 'src3' and (path glob 'src3/en/1*') and doc_type in ('plan', 'exec')")
def stored_filters(spark, sf_dir):
    """An explicit argument wins over a token of the query; the path token narrows by pattern."""
    raw = F.lit("zebra lang:fr path:src3/en/1* type:plan,exec")
    q = spark.range(1).select(T.parse_query(raw).alias("q")).first()["q"]
    explicit = {"language": "en", "source": "src3"}
    v = vault(spark, sf_dir)
    return v.filter((F.col("lang") == (explicit.get("language") or q["language"])) & (F.col("source") == explicit["source"]) & P.matches_any(F.col("path"), [q["path_scope"]]) & F.col("doc_type").isin(*q["doc_type"].split(","))).select("id")


@plans.add("b19_validate_filters", f"""select id, case id % 7 when 0 then true when 1 then false when 2 then doc_type in ('plan', 'adr', 'exec', 'audit', 'reference', 'research') when 3 then lang in ('prod', 'tests', 'docs') when 4 then true when 5 then false else true end as fits from {VAULT_SQL}""")
def filters(spark, sf_dir):
    """Filters with values from the records: a kind, a language where none is taken, a preference that is none, domains, a title, a status."""
    from plinth.api import filter_fits

    i = F.col("id") % 7
    cases = [("vault", "tag", F.col("source")), ("vault", "language", F.col("lang")), ("vault", "doc_type", F.concat_ws(",", "doc_type", F.lit("plan"))), ("codebase", "prefer", F.col("lang")), ("codebase", "only_domain", F.lit("prod,docs")), ("codebase", "only_domain", F.col("source")), ("document", "title", F.col("source"))]
    pick = lambda k: F.element_at(F.array(*(c if isinstance(c, F.Column) else F.lit(c) for c in (x[k] for x in cases))), (i + 1).cast("int"))
    return vault(spark, sf_dir).select("id", filter_fits(pick(0), pick(1), pick(2)).alias("fits"))


@plans.add("c19_i02_i04_vectors_stay_with_rows", "select item_id, true as same from benchmark")
def vectors(spark, sf_dir):
    """Rows go through the encoder by themselves: the vector is that of the row's own text."""
    b = E.encode_table(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text")

    def run(rows):
        import pyarrow as pa

        for r in rows:
            own = [list(E.query_vector(t)) for t in r.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([r.column(0), pa.array([all(abs(x - y) < 1e-6 for x, y in zip(a, v, strict=True)) for a, v in zip(own, r.column(2).to_pylist(), strict=True)])], names=["item_id", "same"])

    return b.select("item_id", "text", "dense").mapInArrow(run, "item_id long, same boolean")


@plans.add("e14_encode_buckets", "select count(*) as n, true as fits from documents")
def buckets(spark, sf_dir):
    """Each task's texts in buckets of their own: a bucket never spans batches."""
    d = table(spark, sf_dir, "documents").select("text")

    def run(rows):
        import pyarrow as pa

        for r in rows:
            texts = [t or "" for t in r.column(0).to_pylist()]
            got = K.encode_buckets(texts)
            groups: dict[int, list[int]] = {}
            for t, g in zip(texts, got, strict=True):
                groups.setdefault(g, []).append(max(1, -(-len(t) // 4)))
            fits = got == sorted(got) and all(len(x) == 1 or len(x) * max(x) <= 24_000 for x in groups.values())
            yield pa.RecordBatch.from_arrays([pa.array([len(texts)], pa.int64()), pa.array([fits])], names=["n", "fits"])

    return d.mapInArrow(run, "n long, fits boolean").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bool_and("fits"), F.lit(True)).alias("fits"))


@plans.add("h30_canonical_json", """select s_suppkey, '{"balance":' || (s_suppkey * 2) || ',"name":"' || s_name || '","none":null}' as j from supplier""")
def canonical(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.canonical_json((F.col("s_suppkey") * 2).alias("balance"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("none")).alias("j"))


@plans.add("h34_chunk_bytes", "select doc_id, 4 * 64 + strlen(text) + strlen(source) as weight from documents where text is not null")
def weights(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", M.chunk_bytes(["text", "source"], 64).alias("weight"))


_ASKED = "'Find the ' || event_type || '. Explain user ' || user_id || ' and how it ' || event_type || 's'"


@plans.add("h43_query_clauses", f"select event_id, {_ASKED} || '|the ' || event_type || '|user ' || user_id || '|how it ' || event_type || 's' as parts from events")
def clauses(spark, sf_dir):
    asked = F.concat(F.lit("Find the "), "event_type", F.lit(". Explain user "), F.col("user_id").cast("string"), F.lit(" and how it "), "event_type", F.lit("s"))

    @F.pandas_udf("string")
    def parts(queries: pd.Series) -> pd.Series:
        return queries.map(lambda q: "|".join(J.query_clauses(q)))

    return table(spark, sf_dir, "events").select("event_id", parts(asked).alias("parts"))


@plans.add("i22_i23_i24_judgment", "select event_id, value <= 50 and event_id % 2 = 0 as dropped, round(case when value > 50 then 0.95 else 0.05 end, 6) as score, case when event_id % 3 = 0 and event_id % 2 = 0 then 'debugging' end as intent from events")
def judged(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sure = F.when(F.col("event_id") % 2 == 0, 0.9).otherwise(0.5)
    v = F.array(F.struct((F.col("value") > 50).alias("useful"), F.lit(0.95).alias("probability"), sure.alias("confidence")))
    verdict, wish = J.judgment(v), J.preferences(F.when(F.col("event_id") % 3 == 0, "debugging").otherwise("unknown"), F.lit("x"), sure, F.lit(False))
    return e.select("event_id", verdict["drop"].alias("dropped"), F.round(verdict["score"], 6).alias("score"), wish["intent"].alias("intent"))


@plans.add("i25_i28_answer_cache", "select user_id, count(*) - count(distinct event_type) as hits, count(distinct event_type) as held from events group by user_id")
def cached(spark, sf_dir):
    """Answers by kind of event, for each user's requests in their order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        answers, hits = J.Answers(), 0
        for kind in rows.sort_values("event_id")["event_type"]:
            if answers.get(kind) is None:
                answers.put(kind, kind)
            else:
                hits += 1
        return pd.DataFrame({"user_id": rows["user_id"].iloc[:1], "hits": [hits], "held": [len(answers._held)]})

    return table(spark, sf_dir, "events").groupBy("user_id").applyInPandas(run, "user_id long, hits long, held long")


@plans.add("i26_link_graph", "select dst::varchar as id, count(distinct src) as in_links from (select conv_id as src, unnest([turn, turn + 1]) as dst from conversations) group by dst")
def graph(spark, sf_dir):
    from plinth.operators.ranking import link_graph

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("src"), F.explode(F.array(F.col("turn").cast("string"), (F.col("turn") + 1).cast("string"))).alias("dst"))
    return link_graph(c)


@plans.add("j06_j07_j08_j09_j10_j14_scopes")
def scopes(spark, sf_dir):
    """Each user's events through the coalescing state machine, run by run."""
    from plinth.streaming.machines import Scope
    from plinth.streaming.watch import folded

    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("double").alias("at"), F.col("event_type").alias("path"))

    def fold(rows):
        s, out = Scope(), []
        for t, path in zip(rows["at"], rows["path"], strict=True):
            if s.evaluate(t) == "ready":
                run = s.start()
                out.append((rows["user_id"].iloc[0], t, len(run.captured), run.over_capacity()))
                s = run.complete(t, 5.0)
            s = s.observe(path, t, 30.0)
        return pd.DataFrame(out, columns=["user_id", "at", "paths", "over"])

    return folded(e, "user_id", "at", "user_id long, at double, paths int, over boolean", fold)


@plans.add("j18_revisions", "select user_id, count(*)::bigint as revision from events group by user_id")
def revisions(spark, sf_dir):
    """A number a publication, rising by one for each root."""
    from plinth.streaming.machines import Revisions
    from plinth.streaming.watch import folded

    def fold(rows):
        r = Revisions()
        for _ in range(len(rows)):
            last = r.publish("root", "vault")
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "revision": [last]})

    return folded(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", "user_id long, revision long", fold)


@plans.add("j19_activity_ledger", "select user_id, min_by(event_type, event_id) as first_end from events group by user_id")
def activity(spark, sf_dir):
    """The first end of a request counts."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_end"))


@plans.add("k07_pandas_reranker", "select doc_id as id, length(text)::double as score from documents")
def reranker(spark, sf_dir):
    """A reranker is any function of batches of texts, as a pandas UDF."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.str.len().astype(float)

    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), score("text").alias("score"))


@plans.add("l01_l02_l16_stamps", "select s_suppkey, ['unstamped', 'ok', 'newer', 'width', 'vector'][(s_suppkey % 5 + 1)::int] as fits, case when s_suppkey % 5 = 0 or s_suppkey % 7 = 0 then 'unverifiable' when s_suppkey % 5 = 1 then 'conforming' else 'nonconforming' end as verdict from supplier")
def stamps(spark, sf_dir):
    """Stamps stored with each supplier: none, ours, a newer one's, another width's or vector's. Where the width in use isn't known, conformance can't be told."""
    own = M.stamp("vault_docs")
    stored = [None, own, {**own, "version": 99}, {**own, "width": 7}, {**own, "vector": "other"}]
    s = table(spark, sf_dir, "supplier").withColumn("stamp", F.element_at(F.array(*(F.lit(json.dumps(x) if x else None) for x in stored)), (F.col("s_suppkey") % 5 + 1).cast("int")))
    live = F.when(F.col("s_suppkey") % 7 != 0, F.lit(own["width"]))
    return s.select("s_suppkey", M.stamp_fits("stamp").alias("fits"), M.stamp_verdict("stamp", own, live).alias("verdict"))


@plans.add("l04_payload_schema", "select 'doc_id' as column_, 'is bigint' as problem union all select 'source_path', 'missing'")
def payload_schema(spark, sf_dir):
    d = spark.createDataFrame([], M.schema("document_docs")).drop("source_path").withColumnRenamed("document_id", "x").withColumn("document_id", F.lit("a"))
    bad = M.payload_errors(d, "document_docs").collect()
    odd = M.payload_errors(table(spark, sf_dir, "documents").select("doc_id"), "vault_docs").filter("column = 'doc_id'").collect()
    return literal(spark, "column_ string, problem string", [(r["column"], r["problem"]) for r in [*bad, *odd]])


@plans.add("l12_route_migration", "select count(*) filter (where o_orderkey % 2 = 0) as destination, count(*) filter (where o_orderkey % 2 = 1) as origin from orders")
def migrated(spark, sf_dir):
    """Rows reach the destination before they leave the origin; a second run changes nothing."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    moving, there = o.filter("id % 2 = 0"), o.limit(0)
    for _ in range(2):
        there = C.upsert(there, moving, ["id"])
        o = C.without_keys(o, there, "id")
    return there.agg(F.count("*").alias("destination")).crossJoin(o.agg(F.count("*").alias("origin")))


@plans.add("l15_kind_fingerprints", """select p_partkey, kind, sha256(case when kind = 'document' then '{"budget":' || p_size || ',"kind":"document"}' else '{"kind":"' || kind || '"}' end) as fingerprint from part, (select unnest(['code', 'document', 'vault']) as kind)""")
def kinds(spark, sf_dir):
    """A part's size as the budget, which counts for documents alone."""
    kind = F.explode(F.array(*map(F.lit, ("code", "document", "vault"))))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", kind.alias("kind"))
    return p.select("p_partkey", "kind", M.kind_fingerprint(F.col("kind"), F.col("p_size")).alias("fingerprint"))


@plans.add("m10_synthetic_vault", "select ['adr','audit','exec','plan','reference','research'][(i % 6 + 1)::int] as doc_type, count(*) as n, count(distinct i) as needles from (select unnest(range(0, (select count(*) from documents))) as i) group by 1")
def synthetic(spark, sf_dir):
    """A corpus as large as the documents table."""
    from plinth.sources.synthetic import vault_corpus

    return vault_corpus(spark, table(spark, sf_dir, "documents").count()).groupBy("doc_type").agg(F.count("*").alias("n"), F.countDistinct("needle").alias("needles"))


@plans.add("n01_n02_n03_n04_n08_n10_engine", f"""select (select count(*) from documents) as vault, (select count(*) from benchmark) as codebase, (select count(*) from conversations) as document,
  (select count(*) from documents) as found, true as combined, 0::bigint as after_clean""")
def engine(spark, sf_dir):
    """Indexes all documents' first lines as records, items as code and turns as document units; each record is found by the word that it alone has."""
    from plinth.api import Engine

    e = Engine(spark, f"{S.scratch(spark)}/engine")
    i = F.col("doc_id").cast("string")
    records = table(spark, sf_dir, "documents").select(F.concat(F.lit("plan/"), i).alias("key"), F.concat(F.lit("---\ntype: plan\ntags: ['#plan', '#"), "source", F.lit("']\n---\n# "), "source", F.lit(" needle"), i, F.lit("\n"), F.substring(F.regexp_extract(F.coalesce("text", F.lit("")), "^[^\n]*", 0), 1, 200)).alias("content"))
    files = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src/f"), F.col("item_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def f"), F.col("item_id").cast("string"), F.lit("():\n    return 1\n")).alias("content"))
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("path"), F.col("turn").cast("int").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("title"), F.lit(None).cast("string").alias("section"))
    out = e.index_all(vault=records, codebase=files, document=turns)
    t = e.table("vault")
    wanted = records.select(F.col("key").alias("qid"), F.concat(F.lit("needle"), F.regexp_extract("key", "[0-9]+", 0)).alias("term"), F.lit(1.0).alias("q"))
    hits = R.sparse_leg(R.term_weights(t.select("id", F.col("content").alias("text")), wanted=wanted), wanted, 1)
    found = hits.filter(F.regexp_replace("id", "#c0$", "") == F.col("qid")).count()
    combined = e.search_combined("return needle0", 5)
    combined = combined is not None and combined.count() > 0
    e.clean()
    return literal(spark, "vault long, codebase long, document long, found long, combined boolean, after_clean long", [(out["vault"]["chunks"], out["codebase"]["chunks"], out["document"]["chunks"], found, combined, sum(e.status().values()))])


@plans.add("h41_classify_root", "select source, case when source is null or source = '' then 'unverifiable' when source like '%1%' then 'orphaned' else 'live' end as status from (select distinct source from documents)")
def roots(spark, sf_dir):
    """Folders of the sources, of which those with a 1 in their name aren't there."""
    from plinth.sources.synthetic import root_status

    top = f"{S.scratch(spark)}/roots"
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    d.filter("source not like '%1%'").repartition("source").write.partitionBy("source").parquet(top)
    return root_status(d.select("source").distinct().withColumn("root", F.concat(F.lit(f"{top}/source="), "source")), top).select("source", "status")

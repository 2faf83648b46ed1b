"""File admission, logs, progress, activity, maintenance and pressure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators import catalog as C
from plinth.operators import progress as G
from plinth.plans.base import Plans, literal, literal_sql, table
from plinth.sources import files as S

plans = Plans()
QUERIES, SQL = plans.queries, plans.sql

_IGNORE = [("", "build/"), ("", "!keep/build/"), ("", "*.bin"), ("", "# note"), ("", "!node_modules/"), ("lib", ".hid*")]
_ROUTES = [("src/*.txt", "document"), ("docs/*", "vault")]
_FOLDERS = ["", "src/", "docs/", "node_modules/m/", "build/", "keep/build/", ".vault/p/", "w/.claude/worktrees/", "lib/.hid/", ".claude/worktrees/w/"]
_SUFFIXES = [".py", ".rs", ".md", ".js", ".jsx", ".ts", ".tsx", ".go", ".java", ".c", ".h", ".cpp", ".hpp", ".cc", ".cs", ".rb", ".sh", ".bash", ".yaml", ".yml", ".toml", ".json", ".html", ".css", ".kt", ".txt", ".properties", ".xml", ".xsd", ".bin", ".PY", "", ".rst"]

# Fixed values, suffix by suffix: language, grammar, whether the conventional profile takes it.
_SUFFIX_SQL = """(values ('.py', 'python', 'python', true), ('.rs', 'rust', 'rust', true), ('.md', 'markdown', null, false), ('.js', 'javascript', 'javascript', true), ('.jsx', 'javascript', 'javascript', true),
  ('.ts', 'typescript', 'typescript', true), ('.tsx', 'typescript', 'tsx', true), ('.go', 'go', 'go', true), ('.java', 'java', 'java', true), ('.c', 'c', 'c', true), ('.h', 'c', 'c', true), ('.cpp', 'cpp', 'cpp', true),
  ('.hpp', 'cpp', 'cpp', true), ('.cc', 'cpp', 'cpp', true), ('.cs', 'csharp', 'csharp', true), ('.rb', 'ruby', 'ruby', true), ('.sh', 'shell', 'bash', true), ('.bash', 'shell', 'bash', true), ('.yaml', 'yaml', null, false),
  ('.yml', 'yaml', null, false), ('.toml', 'toml', null, false), ('.json', 'json', null, false), ('.html', 'html', null, false), ('.css', 'css', null, true), ('.kt', 'kotlin', 'kotlin', true), ('.txt', 'text', null, false),
  ('.properties', 'text', null, false), ('.xml', 'xml', null, false), ('.xsd', 'xml', null, false)) as k(known, language, grammar, code)"""
_PATHS_SQL = f"(select ({_FOLDERS})[doc_id % {len(_FOLDERS)} + 1] as folder, ({_SUFFIXES})[(doc_id // {len(_FOLDERS)}) % {len(_SUFFIXES)} + 1] as suffix, folder || 'f' || doc_id || suffix as path from documents)"
_KIND_SQL = f"""(select path, suffix, case when folder in ('node_modules/m/', 'build/', '.vault/p/', '.claude/worktrees/w/', 'lib/.hid/') or suffix = '.bin' then 'ignored' when folder = 'docs/' then 'vault' when folder = 'src/' and suffix = '.txt' then 'document' when coalesce(code, false) then 'code' else 'none' end as found
  from {_PATHS_SQL} left join {_SUFFIX_SQL} on known = lower(suffix))"""
_ADMITTED_SQL = f"select path, case found when 'ignored' then null when 'none' then 'code' else found end as kind, found not in ('ignored', 'none') as admitted, case found when 'ignored' then 'ignored' when 'none' then 'source_profile_excluded' when 'code' then 'source_profile' else 'explicit_route' end as reason from {_KIND_SQL}"


def listing(spark, sf_dir):
    """A path for each document, over folders and suffixes."""

    def nth(values, i):
        return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))

    i = F.col("doc_id")
    path = F.concat(nth(_FOLDERS, i), F.lit("f"), i.cast("string"), nth(_SUFFIXES, F.floor(i / len(_FOLDERS))))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.lit(100).cast("long").alias("length"))


def classified(spark, sf_dir):
    ignored = S.is_ignored(F.col("path"), S.ignore_rules(_IGNORE))
    return listing(spark, sf_dir).select("path", "length", S.classify(F.col("path"), ignored, _ROUTES).alias("c")).select("path", "length", "c.*")


@plans.add("a08_a10_a11_a13_classify_content", _ADMITTED_SQL)
def admission(spark, sf_dir):
    return classified(spark, sf_dir).select("path", "kind", "admitted", "reason")


@plans.add("a04_a05_n12_scan_dispositions", f"select kind, admitted, reason, count(*) as n from ({_ADMITTED_SQL}) group by all")
def scanned(spark, sf_dir):
    return S.dispositions(classified(spark, sf_dir))


@plans.add("a06_a07_raw_code_refusal", "select case when doc_id % 3 = 0 then 'source_too_large' when doc_id % 3 = 1 and strlen(text) < 8192 then 'source_binary' end as refusal, count(*) as n from documents group by all")
def refused(spark, sf_dir):
    i = F.col("doc_id") % 3
    content = F.concat(F.encode("text", "UTF-8"), F.when(i == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("20"))))
    length = F.when(i == 0, F.lit(S.MAX_SOURCE_BYTES + 1)).otherwise(100)
    return table(spark, sf_dir, "documents").filter("text is not null").groupBy(S.code_refusal(length, content).alias("refusal")).agg(F.count("*").alias("n"))


@plans.add("a09_route_owner", f"select path, case when folder = 'docs/' then 'vault' when suffix = '.txt' and folder = 'src/' then 'document' end as kind from {_PATHS_SQL}")
def owners(spark, sf_dir):
    return listing(spark, sf_dir).select("path", S.routed_kind(F.col("path"), [*_ROUTES, ("src/f*.txt", "document")]).alias("kind"))


@plans.add("h05_select_parser", f"select path, coalesce(language, 'text') as language, grammar from {_PATHS_SQL} left join {_SUFFIX_SQL} on known = lower(suffix)")
def parsers(spark, sf_dir):
    return listing(spark, sf_dir).select("path", S.parser(F.col("path")).alias("p")).select("path", "p.*")


@plans.add("a21_match_rule", "select page_id, case when url glob '*/fr/*' then 'french' when url glob 'https*' then 'secure' when url glob '*' then 'any' end as rule from pages")
def rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return S.match_rules(pages, [(5, "*", "any"), (1, "*/fr/*", "french"), (5, "x*", "never"), (2, "https*", "secure")]).select("page_id", "rule")


@plans.add("a51_partition_batches", "select path, rule, ((row_number() over (partition by rule order by path) - 1) // 64)::int as batch from (select url || page_id as path, page_id % 3 as rule from pages)")
def batched(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat("url", F.col("page_id").cast("string")).alias("path"), (F.col("page_id") % 3).alias("rule"))
    return S.batches(pages)


@plans.add("a53_h32_hash_paths", "select doc_id::varchar as path, case when doc_id % 2 = 0 and doc_id % 3 <> 0 then 'stored' else sha256(text) end as digest, doc_id % 2 = 0 and doc_id % 3 <> 0 as reused from documents")
def hashed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("length"), F.lit(100.0).alias("modified"), F.encode("text", "UTF-8").alias("content"))
    known = d.filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("length"), F.lit(100.0).alias("modified"), F.when(F.col("doc_id") % 3 == 0, 101.5).otherwise(102.0).alias("hashed_at"), F.lit("stored").alias("digest"))
    return S.hash_paths(files, known)


@plans.add("a22_a23_cached_output", "select s_suppkey as key, case when s_suppkey % 2 = 0 and s_suppkey % 5 <> 0 then s_name end as output from supplier")
def cached(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("output"))
    cache = s.filter("key % 2 = 0").withColumn("identity", F.when(F.col("key") % 5 == 0, "old").otherwise("v1"))
    return S.cached_outputs(s.select("key", F.lit("v1").alias("identity")), cache).select("key", "output")


@plans.add("a52_split_batch_output", "select conv_id as batch, turn::varchar as path, case when conv_id % 5 <> 0 and turn % 3 <> 2 then role end as text, conv_id % 5 = 0 or turn % 3 = 2 as failed from conversations where role is not null group by all")
def batch_output(spark, sf_dir):
    """Conversations as batches: one in five is unreadable, each third turn has no text, and each first one comes twice, with an element for no path."""
    c = table(spark, sf_dir, "conversations").filter("role is not null").select("conv_id", "turn", "role").distinct()
    element = F.struct(F.col("turn").cast("string").alias("path"), F.when(F.col("turn") % 3 != 2, F.col("role")).alias("text"))
    made = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(element)).alias("e"))
    first = F.struct(F.col("e")[0]["path"].alias("path"), F.lit("an earlier text").alias("text"))
    other = F.struct(F.lit("no such path").alias("path"), F.lit("x").alias("text"))
    out = made.select(F.col("conv_id").alias("batch"), F.when(F.col("conv_id") % 5 == 0, "not json").otherwise(F.to_json(F.concat(F.array(first, other), "e"))).alias("json"))
    return S.split_batch_output(out, c.select(F.col("conv_id").alias("batch"), F.col("turn").cast("string").alias("path")))


@plans.add("a03_vault_document", "select doc_id, source as feature, 'Title ' || doc_id as title, ['#plan', '#' || source] as tags, case when doc_id % 2 = 0 then '2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') end as date from documents")
def records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("---\ntags:\n  - '#plan'\n  - '#"), "source", F.lit("'\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("date: 2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("\n"))).otherwise(""), F.lit("---\n# Title "), F.col("doc_id").cast("string"), F.lit("\nbody"))
    front, body = S.front_matter(F.col("raw"))
    r = d.select("doc_id", raw.alias("raw")).select("doc_id", front.alias("front"), body.alias("body"))
    tags = S.front_list(F.col("front"), "tags")
    return r.select("doc_id", T.feature(tags).alias("feature"), T.title(F.col("body")).alias("title"), tags.alias("tags"), S.front_field(F.col("front"), "date").alias("date"))


@plans.add("a01_a02_read_records", "select 'item_id=' || item_id || '/record' as key, sha256(text || chr(10)) as digest from benchmark where text is not null")
def read_back(spark, sf_dir):
    """Items as Markdown files in folders of their own, among files that are no records."""
    top = f"{S.scratch(spark)}/records"
    table(spark, sf_dir, "benchmark").filter("text is not null").select("item_id", F.replace("text", F.lit("\r"), F.lit("")).alias("value")).write.partitionBy("item_id").text(top)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(top)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(where):
        for f in fs.listStatus(folder.getPath()) if folder.isDirectory() else []:
            if f.getPath().getName().startswith("part-"):
                fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(folder.getPath(), "record.md"))
    return S.read_records(spark, top).select("key", F.sha2("content", 256).alias("digest"))


# Logs: events as lines


def lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("log"), F.col("event_id").alias("seq"), F.concat_ws(" ", F.lit("request_id=r"), F.col("user_id").cast("string"), "event_type").alias("line"))


@plans.add("a50_b30_log_query", "select event_id as seq from events where contains(lower('request_id=r ' || user_id || ' ' || event_type), 'click') qualify row_number() over (partition by event_type order by event_id desc) <= 20")
def log_tail(spark, sf_dir):
    return S.tail_lines(S.match_lines(lines(spark, sf_dir), "CLICK", "r"), "log", 20).select("seq")


@plans.add("e09_newest_within_budget", "select event_id as seq from events qualify sum(strlen('request_id=r ' || user_id || ' ' || event_type) + 1) over (partition by event_type order by event_id desc) <= 1000")
def budget(spark, sf_dir):
    return S.newest_within(lines(spark, sf_dir), "log", 1000).select("seq")


# Progress: events as samples


def samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", (F.col("event_id") * 0.5).alias("at"), F.col("event_type").alias("step"), (F.col("event_id") % 97).alias("done"))


_SAMPLES = "(select user_id as job, event_id, event_id * 0.5::double as tm, event_type as step, event_id % 97 as done from events)"


@plans.add("e10_j20_window_rate", f"select job, event_id, case when s >= 1 and g > 0 then round(g / s, 6) end as rate from (select *, tm - first(tm) over w as s, done - first(done) over w as g from {_SAMPLES} window w as (partition by job order by event_id rows 15 preceding))")
def rates(spark, sf_dir):
    return G.window_rate(samples(spark, sf_dir), ["job"], ["event_id"], "at", "done").select("job", "event_id", F.round("rate", 6).alias("rate"))


@plans.add("e11_progress_windows", f"select job, event_id, part from (select *, sum(r) over (partition by job order by tm) as part from (select *, coalesce((lag(step) over w <> step or lag(done) over w > done)::int, 0) as r from {_SAMPLES} window w as (partition by job order by tm))) qualify not coalesce(lead(tm) over (partition by job, part order by tm) - tm < 0.25, false)")
def parts(spark, sf_dir):
    return G.progress_windows(samples(spark, sf_dir), "job", "at", "step", "done").select("job", "event_id", "part")


@plans.add("d13_baseline_rate", f"select job, case when count(rate) >= 8 then round(median(rate), 6) end as baseline from ({SQL['e10_j20_window_rate']}) group by job")
def baselines(spark, sf_dir):
    return G.baseline_rate(rates(spark, sf_dir), "job").select("job", F.round("baseline", 6).alias("baseline"))


@plans.add("h38_h39_job_verdict", "select event_id, case when event_id % 400 >= 300 then 'stalled' when event_id % 400 >= 60 or value / 100 <= 0.25 then 'degraded' else 'healthy' end as verdict, case when value > 0 then round((1000 - event_id % 1000) / value, 1) end as left_seconds from events")
def verdicts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    _, left = G.estimate(F.col("value"), F.col("event_id") % 1000, F.lit(1000))
    return e.select("event_id", G.degradation((F.col("event_id") % 400).cast("double"), F.col("value"), F.lit(100.0)).alias("verdict"), left.alias("left_seconds"))


@plans.add("h35_jittered_backoff", "select event_id, round(least(1800.0, greatest(0.0, n + n * 0.1 * (2 * u - 1))), 6) as wait from (select event_id, least(30 * pow(2.0, event_id % 9), 1800.0) as n, (event_id % 101) / 100.0::double as u from events)")
def waits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(G.backoff((F.col("event_id") % 9).cast("double"), 30.0, 1800.0, 0.1, (F.col("event_id") % 101) / 100.0), 6).alias("wait"))


@plans.add("h36_coalesce_delay", "select user_id, round(2 + 28 * least(1.0, 0.4 * least(e / s / 10, 1) + 0.2 * greatest(0, 1 - n / e) + 0.2 * least(n / 1000, 1) + 0.2 * 0.5), 6) as delay from (select user_id, count(*)::double as n, 2.0::double * count(*) as e, greatest(max(event_id) + 1 - min(event_id), 1)::double as s from events group by user_id)")
def delays(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("double").alias("first_at"), (F.col("event_id") + 1.0).alias("latest_at"), F.array(F.lit("a"), F.lit("b")).alias("kinds"))
    return G.coalesce_delay(e, ["user_id"], 60.0).select("user_id", F.round("delay", 6).alias("delay"))


@plans.add("h37_pressure_tiers", "select event_id, case when value > 95 then 2 when value > 70 or event_id % 10 = 0 then 1 else 0 end as tier from events")
def tiers(spark, sf_dir):
    v = F.col("value")
    p = G.pressure({"store_failed": v > 95}, {"slow": v > 70, "waiting": F.col("event_id") % 10 == 0})
    return table(spark, sf_dir, "events").select("event_id", p["tier"].alias("tier"))


@plans.add("d16_store_failures", "select 'store_' || event_type as finding from events where event_type = 'purchase' group by event_type union all select 'store_' || event_type || '_repeated' from events where event_type in ('click', 'view') group by event_type having count(*) >= 2")
def failures(spark, sf_dir):
    return G.store_failures(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind")), ["purchase"], ["click", "view"])


# Activity: orders as jobs


@plans.add("d10_job_summary", "select 'o_orderstatus' as dimension, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2")
def summary(spark, sf_dir):
    return G.job_summary(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@plans.add("b28_b29_matching_jobs", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderkey::varchar like '1%' and o_orderdate >= '1996-01-01' and contains(lower(o_orderpriority || ' ' || o_orderstatus), 'high')")
def matching(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("key", F.col("o_orderkey").cast("string"))
    return G.matching_jobs(o, {"o_orderstatus": "O"}, ("key", "1"), ("o_orderdate", "1996-01-01"), "HIGH", ["o_orderpriority", "o_orderstatus"]).select("o_orderkey")


@plans.add("f10_f11_sorted_records", "select o_orderkey from orders order by case o_orderstatus when 'P' then 1 when 'F' then 2 else 3 end desc, o_orderkey limit 25")
def ordered(spark, sf_dir):
    return G.sorted_records(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", True, ["P", "F"]).select("o_orderkey").limit(25)


@plans.add("e07_l08_cycle_cap", "select s_suppkey, s_acctbal > 0 and sum((s_acctbal > 0)::int) over (order by s_suppkey) <= 7 as act from supplier")
def capped(spark, sf_dir):
    return G.within_cycle(table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") > 0).alias("eligible")), ["s_suppkey"], 7).select("s_suppkey", "act")


@plans.add("e08_sweep_archive", "select c_custkey as name, case when old then 'expired' when sum(size) over (partition by old order by tm desc, c_custkey) > 20000 then 'evicted' else 'kept' end as verdict from (select c_custkey, c_custkey % 100 as tm, c_nationkey * 100 as size, 100 - c_custkey % 100 > 60 as old from customer)")
def swept(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), (F.col("c_custkey") % 100).cast("double").alias("at"), (F.col("c_nationkey") * 100).cast("long").alias("bytes"))
    return G.sweep(c, 100.0, 60.0, 20_000).select("name", "verdict")


@plans.add("h40_l06_l09_orphan_decision", "select c_custkey, case when c_custkey % 7 = 0 then 'held' when c_custkey % 3 <> 0 then 'live' when c_custkey % 5 = 0 then 'pending' when c_nationkey >= 12 then 'reclaim' else 'pending' end as decision from customer")
def orphans(spark, sf_dir):
    k = F.col("c_custkey")
    d = G.orphan_decision(F.when(k % 3 == 0, "orphaned").otherwise("live"), F.when(k % 5 != 0, F.col("c_nationkey")), F.lit(12), k % 7 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", d.alias("decision"))


@plans.add("l07_l10_advance_stamps", "select s_suppkey as name, case when s_suppkey % 2 = 0 then 'then' else 'now' end as since from supplier where s_suppkey % 3 = 0")
def stamps(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"))
    return G.advance_stamps(s.filter("name % 2 = 0").withColumn("since", F.lit("then")), s.filter("name % 3 = 0"), "now")


@plans.add("h42_activity_stamps", "select user_id, event_id, last_value(case when changed then event_id end ignore nulls) over (partition by user_id order by event_id) as idle_since from (select *, coalesce(lag(event_type) over (partition by user_id order by event_id) <> event_type, true) as changed from events)")
def idle(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.col("event_id"))
    return G.activity_stamps(e, "user_id", "event_id", "event_type", "at")


@plans.add("c15_classify_namespaces", "select 'r' || lpad(lower(to_hex(s_nationkey)), 12, '0') || '_' as prefix, count(*) as collections, sum(s_suppkey) as points, case when s_nationkey % 2 = 0 then 'attributed' else 'unattributed' end as status from supplier group by s_nationkey")
def spaces(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    prefix = F.concat(F.lit("r"), F.lpad(F.lower(F.hex("s_nationkey")), 12, "0"), F.lit("_"))
    found = s.select(F.concat(prefix, F.lit("vault_docs_"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").alias("points")).unionByName(s.select(F.lit("other").alias("name"), F.lit(1).cast("long").alias("points")))
    known = s.filter("s_nationkey % 2 = 0").select(prefix.alias("prefix"), F.lit("/x").alias("root")).distinct()
    return G.namespaces(found, known).drop("root")


@plans.add("d09_kind_points", "select sum(case when s_suppkey % 3 <> 2 then s_suppkey end) as points from supplier")
def points(spark, sf_dir):
    i = F.col("s_suppkey") % 3
    c = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r1_vault_docs"), F.when(i == 1, "_gA1").when(i == 2, "_old_x").otherwise("")).alias("name"), F.col("s_suppkey").alias("points"))
    return G.kind_points(c, "vault_docs")


@plans.add("l11_plan_reconcile", "select s_name as name from supplier where s_nationkey <> 3 order by coalesce(case when s_suppkey % 4 <> 0 then s_acctbal end, 0) desc, s_name limit 10")
def reconcile(spark, sf_dir):
    e = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("setting"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("bytes"))
    return G.plan_reconcile(e, 3, 10).select("name")


@plans.add("g08_l05_unreferenced_generations", "select s_name || '_g' || s_suppkey as name from supplier where s_suppkey % 2 = 1 and s_suppkey % 3 <> 0")
def generations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    there = s.select(F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 1, F.concat(F.lit("_g"), F.col("s_suppkey").cast("string"))).otherwise("")).alias("name"))
    used = s.filter("s_suppkey % 3 = 0").select(F.concat("s_name", F.lit("_g"), F.col("s_suppkey").cast("string")).alias("name"))
    return C.without_keys(there.filter(F.col("name").rlike("_g[0-9A-Za-z]+$")), used, "name")


@plans.add("d18_readiness", "select count(*) filter (where value > 20) > 0 as usable, case when bool_or(event_id % 1000 = 7) then 'unverifiable' when bool_or(value > 50) then 'updating' else 'current' end as freshness, bool_and(value > 20 and value <= 50 and event_id % 1000 <> 7) as authoritative from events")
def ready(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return G.readiness(e.select((F.col("value") > 20).alias("usable"), F.when(F.col("event_id") % 1000 == 7, "unverifiable").when(F.col("value") > 50, "updating").otherwise("current").alias("freshness")))


@plans.add("d12_d19_claims", "select s_suppkey, case when s_suppkey % 4 = 0 then 'unverifiable' when s_suppkey % 10 >= 5 then 'consistent' else 'shrunken' end as verdict, case when s_suppkey % 4 <> 0 and s_suppkey % 10 < 5 then 5 - s_suppkey % 10 end as short from supplier")
def claims(spark, sf_dir):
    live = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 10)
    return table(spark, sf_dir, "supplier").select("s_suppkey", G.claim(live, F.lit(5)).alias("verdict"), G.shortfall(F.lit(5), live).cast("long").alias("short"))


@plans.add("e15_fair_choice", "select r_name as key from region order by 1, 1 limit 1 offset 2")
def fair(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.lit(1.0).alias("deadline"))
    second = sorted(x["key"] for x in r.collect())[1]
    return G.fair_choice(r, second).select("key")


@plans.add("j17_hit_freshness", "select s_suppkey as path, case when s_suppkey % 5 = 0 then 'file_missing' when s_suppkey % 7 = 0 then 'unverifiable' when s_suppkey % 2 = 0 then 'current' else 'content_changed' end as verdict from supplier")
def fresh(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"))
    now = s.filter("path % 5 <> 0").select("path", F.when(F.col("path") % 2 == 0, "d").otherwise("e").alias("now"), (F.col("path") % 7 != 0).alias("readable"))
    return G.hit_freshness(s.withColumn("digest", F.lit("d")), now).select("path", "verdict")


@plans.add("j24_path_delta", "select o_orderkey, case when o_orderstatus = 'F' then o_totalprice > 200000 when o_orderstatus = 'O' then true else false end as valid from orders")
def path_deltas(spark, sf_dir):
    from plinth.operators.changes import valid_delta

    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "rename").when(F.col("o_orderstatus") == "O", "add").otherwise("unheard")
    target = F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000), F.lit("there"))
    return o.select("o_orderkey", valid_delta(kind, F.lit("here"), target, F.lit("digest")).alias("valid"))

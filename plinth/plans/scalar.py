"""Scalar functions over tables: parsing, paths, identities, chunk inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import paths as P
from plinth.functions import text as T
from plinth.operators.retrieval import checked_broadcast
from plinth.plans.base import VAULT_SQL, Plans, literal, literal_sql, table, vault

plans = Plans()
QUERIES, SQL = plans.queries, plans.sql

_TOK = T.TOKEN_PATTERN
_RAW = "concat('  type:', doc_type, ' ', regexp_extract(content, '^\\S+', 0), '  my-lang:', lang, ' tag:##', source, case when id % 2 = 0 then ' exclude:tests exclude:docs,locale type:plan' else ' only:prod xtype:no' end, '  path:src/', id, ' end ')"


def _last(token: str) -> str:
    return f"list_filter(list_zip(regexp_extract_all(raw, '{_TOK}', 1), regexp_extract_all(raw, '{_TOK}', 2)), lambda z: z[1] = '{token}')[-1][2]"


@plans.add("b01_parse_query", f"""select id, trim(regexp_replace(regexp_replace(raw, '{_TOK}', '', 'g'), '\\s+', ' ', 'g')) as "text", {_last('type')} as doc_type, {_last('lang')} as language,
  regexp_replace({_last('tag')}, '^#+', '') as tag, {_last('path')} as path_scope, {_last('only')} as only_domain,
  nullif(array_to_string(list_transform(list_filter(list_zip(regexp_extract_all(raw, '{_TOK}', 1), regexp_extract_all(raw, '{_TOK}', 2)), lambda z: z[1] = 'exclude'), lambda z: z[2]), ','), '') as exclude_domain
  from (select id, {_RAW} as raw from {VAULT_SQL})""")
def parse_query(spark, sf_dir):
    raw = vault(spark, sf_dir).select("id", F.expr(_RAW.replace("\\S", "\\\\S")).alias("raw"))
    q = raw.select("id", T.parse_query(F.col("raw")).alias("q"))
    return q.select("id", "q.text", "q.doc_type", "q.language", "q.tag", "q.path_scope", "q.only_domain", "q.exclude_domain")


@plans.add("b06_merge_domain_tokens", f"select id, list_concat(['docs'], list_filter(list_transform(string_split(case when id % 3 = 0 then 'tests, locale,,' when id % 3 = 1 then 'vendored' end, ','), lambda x: trim(x)), lambda x: x <> '')) as domains from {VAULT_SQL}")
def merge_domains(spark, sf_dir):
    token = F.when(F.col("id") % 3 == 0, "tests, locale,,").when(F.col("id") % 3 == 1, "vendored")
    return vault(spark, sf_dir).select("id", T.merged_domains(token, ["docs"]).alias("domains"))


PATHS = [
    "src/app.py", "src/tests/util.py", "tests/test_app.py", "a/test_x.py", "a/x_test.go", "a/x_spec.rb", "conftest.py", "docs/index.html", "README.md", "readme", "LICENSE", "CHANGELOG.txt", "a/notes.rst", "a/b.adoc",
    "locales/en.yml", "config/en.yml", "app/messages.en.po", "i18n/en/messages.po", "lang/de.json", "a/fr/b.toml", "a/xyz.json", "a/EN.YML", "node_modules/x/index.js", "vendor/lib/a.go", "a/dist/b.js", "build/out.txt", "site-packages/p/q.py",
    "__pycache__/a.pyc", "a/generated/b.ts", "a/b.min.js", "a/c.generated.go", "x_pb2.py", "x_pb2_grpc.py", "y.pb.go", "z.g.dart", ".claude/worktrees/w1/src/a.py", ".git/worktrees/w2/a", "worktrees/a.py", "a\\tests\\b.py", "/abs/src/x.rs", "", "Tests/a.py", "a/spec/b.js", "docs", "venv/lib/a.py", "x.test.js",
]
_PATHS_SQL = literal_sql(["path"], [(p,) for p in PATHS])


def _in(names: tuple[str, ...]) -> str:
    return "list_has_any(dirs, [" + ", ".join(f"'{n}'" for n in names) + "])"


def _like(names: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"base glob '{n}'" for n in names) + ")"


_EXT = "|".join(P.LOCALE_EXTENSIONS)
DOMAIN_SQL = f"""case when regexp_matches('/' || array_to_string(segs, '/') || '/', '/\\.(claude|git)/worktrees/') then 'worktree'
  when {_in(P.VENDORED_DIRS)} then 'vendored' when {_in(P.GENERATED_DIRS)} or {_like(P.GENERATED_NAMES)} then 'generated'
  when {_in(P.TEST_DIRS)} or {_like(P.TEST_NAMES)} then 'tests'
  when {_in(P.LOCALE_DIRS)} or regexp_matches(base, '^([a-z]{{2}}|.*\\.[a-z]{{2}})\\.({_EXT})$') then 'locale'
  when {_in(P.DOC_DIRS)} or {_like(P.DOC_NAMES)} or regexp_matches(base, '\\.({'|'.join(P.DOC_EXTENSIONS)})$') then 'docs' else 'prod' end"""


def parts_sql(source: str) -> str:
    return f"(select *, segs[:-2] as dirs, lower(coalesce(segs[-1], '')) as base from (select *, string_split(trim(replace(path, '\\', '/'), '/'), '/') as segs from {source}))"


def _all_paths(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[^:]+://[^/]+/([^?#]*)", 1).alias("path"))
    return literal(spark, "path string", [(p,) for p in PATHS]).unionByName(urls)


_ALL_PATHS_SQL = f"(select path from {_PATHS_SQL} union all select regexp_extract(url, '^[^:]+://[^/]+/([^?#]*)', 1) as path from pages)"


@plans.add("b13_classify_domain", f"select path, {DOMAIN_SQL} as domain from {parts_sql(_ALL_PATHS_SQL)}")
def domains(spark, sf_dir):
    return _all_paths(spark, sf_dir).select("path", P.classify_domain(F.col("path")).alias("domain"))


@plans.add("b14_b15_b16_domain_predicates", f"""select path, regexp_matches('/' || array_to_string(segs, '/') || '/', '/\\.(claude|git)/worktrees/') as worktree,
  {_in(P.LOCALE_DIRS)} or regexp_matches(base, '^([a-z]{{2}}|.*\\.[a-z]{{2}})\\.({_EXT})$') as locale,
  {_in(P.DOC_DIRS)} or {_like(P.DOC_NAMES)} or regexp_matches(base, '\\.({'|'.join(P.DOC_EXTENSIONS)})$') as docs from {parts_sql(_ALL_PATHS_SQL)}""")
def domain_predicates(spark, sf_dir):
    segments, directories, base = P.path_parts(F.col("path"))
    return _all_paths(spark, sf_dir).select("path", P.is_worktree(segments).alias("worktree"), P.is_locale(directories, base).alias("locale"), P.is_docs(directories, base).alias("docs"))


@plans.add("b12_domain_of_payload", f"select path, coalesce(nullif(stored, ''), {DOMAIN_SQL}) as domain from {parts_sql(f'(select path, case when length(path) % 3 = 0 then {chr(39)}vendored{chr(39)} when length(path) % 3 = 1 then {chr(39)}{chr(39)} end as stored from {_ALL_PATHS_SQL})')}")
def payload_domain(spark, sf_dir):
    n = F.length("path") % 3
    return _all_paths(spark, sf_dir).select("path", P.stored_domain(F.when(n == 0, "vendored").when(n == 1, ""), F.col("path")).alias("domain"))


@plans.add("h20_chunk_category", f"select category, count(*) as n from (select case when d in ('tests', 'docs') then d else 'prod' end as category from (select {DOMAIN_SQL} as d from {parts_sql(_ALL_PATHS_SQL)})) group by category")
def categories(spark, sf_dir):
    return _all_paths(spark, sf_dir).groupBy(P.chunk_category(F.col("path")).alias("category")).agg(F.count("*").alias("n"))


@plans.add("b11_partition_hard_domains", f"""select domain, count(*) as n, count(*) filter (where domain in ('worktree', 'generated', 'vendored') or domain not in ('prod', 'tests', 'vendored')) as dropped
  from (select {DOMAIN_SQL} as domain from {parts_sql(_ALL_PATHS_SQL)}) group by domain""")
def hard_domains(spark, sf_dir):
    policy = P.resolve_noise(exclude=["vendored"], only=["prod", "tests", "vendored"])
    d = _all_paths(spark, sf_dir).select(P.classify_domain(F.col("path")).alias("domain"))
    gone = ~F.col("domain").isin(*sorted(policy["only"])) | F.col("domain").isin(*sorted(policy["hide"]))
    return d.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(gone).alias("dropped"))


_SET = "list_sort(list_filter(['docs', 'generated', 'locale', 'prod', 'tests', 'vendored', 'worktree'], lambda x: {}))"
_EXCLUDED, _ONLY, _BACK = "(event_id % 2 = 0 and x = 'docs' or event_id % 3 = 0 and x = 'tests')", "(event_id % 5 = 0 and x in ('prod', 'tests'))", "(event_id % 7 = 0 and x in ('worktree', 'docs'))"
_HIDE = f"(x in ('worktree', 'generated') or {_EXCLUDED}) and not {_BACK}"
_DEMOTE = f"x in ('tests', 'docs', 'locale', 'vendored') and not {_BACK} and not ({_HIDE})"


@plans.add("b10_resolve_noise_policy", f"select event_id, {_SET.format(_HIDE)} as hide, {_SET.format(_ONLY)} as only_, {_SET.format(_DEMOTE)} as demote from events")
def noise_policy(spark, sf_dir):
    """Each event asks for a policy of its own; unknown names and prod can't be hidden."""
    i = F.col("event_id")
    some = lambda on, *names: F.when(on, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    policy = P.noise_sets(F.concat(some(i % 2 == 0, "docs", "prod"), some(i % 3 == 0, " Tests")), some(i % 5 == 0, "prod", "TESTS", "x"), some(i % 7 == 0, "worktree", "docs"))
    return table(spark, sf_dir, "events").select("event_id", *(F.sort_array(policy[k]).alias("only_" if k == "only" else k) for k in ("hide", "only", "demote")))


def _start(x: str) -> str:
    return f"case when {x} = '' then '/' else {x} end"


_A, _B, _C = (rf"^((?:.*/)?)[a-z]{{2}}\.((?i:{_EXT}))$", rf"^((?:.*/)?)[a-z]{{2}}/([^/]*)\.((?i:{_EXT}))$", rf"^((?:.*/)?)([^/]*)\.[a-z]{{2}}\.((?i:{_EXT}))$")
LOCALE_SQL = f"""case when regexp_matches(path, '{_A}') then {_start(f"regexp_extract(path, '{_A}', 1)")} || '*.' || regexp_extract(path, '{_A}', 2)
  when regexp_matches(path, '{_B}') then {_start(f"regexp_extract(path, '{_B}', 1)")} || '*/' || regexp_extract(path, '{_B}', 2) || '.' || regexp_extract(path, '{_B}', 3)
  when regexp_matches(path, '{_C}') then {_start(f"regexp_extract(path, '{_C}', 1)")} || regexp_extract(path, '{_C}', 2) || '.*.' || regexp_extract(path, '{_C}', 3) end"""


@plans.add("h19_locale_key", f"select path, {LOCALE_SQL} as key from {_ALL_PATHS_SQL}")
def locale_keys(spark, sf_dir):
    return _all_paths(spark, sf_dir).select("path", P.locale_key(F.col("path")).alias("key"))


@plans.add("b07_b08_b09_path_globs", f"select path from {_ALL_PATHS_SQL} where (path = 'src' or path glob 'src/*' or path glob '*.y?l' or path glob '[a-c]/*' or path = 'en' or path glob 'en/*') and not (path = 'src/tests' or path glob 'src/tests/*' or path glob '*/9*')")
def globs(spark, sf_dir):
    return _all_paths(spark, sf_dir).filter(P.path_filter(F.col("path"), ["src/", "*.y?l", "[a-c]/*", "en"], ["src/tests", "*/9*"]))


@plans.add("h24_stable_id", "select doc_id, (cast('0x' || substr(sha256(doc_id::varchar || '#c0'), 1, 16) as ubigint) & 9223372036854775807::ubigint)::bigint as point_id from documents")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.stable_id(F.concat(F.col("doc_id").cast("string"), F.lit("#c0"))).alias("point_id"))


@plans.add("h25_root_prefix", "select source, 'r' || substr(sha256('/data/' || source), 1, 12) || '_' as prefix from documents group by source")
def prefixes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", P.root_prefix(F.concat(F.lit("\\data//"), F.col("source"), F.lit("/"))).alias("prefix"))


_ODD = ["a/{}.pdf", "./a//{}.pdf", "a\\{}\\c.docx", "/etc/{}", "../{}", "a/../{}", "C:\\{}", "", "  ", ".", "a/./{}/", "ok/{}.txt"]
_PLAIN = ["a/{}.pdf", "a/{}.pdf", "a/{}/c.docx", None, None, None, None, None, None, None, "a/{}", "ok/{}.txt"]


@plans.add("h27_source_path", f"select doc_id, replace([{', '.join('NULL' if p is None else repr(p) for p in _PLAIN)}][(doc_id % 12 + 1)::int], '{{}}', doc_id::varchar) as plain from documents")
def source_paths(spark, sf_dir):
    """Documents under paths with doubled, other and last slashes, dots, drives and ways up."""
    path = F.replace(F.element_at(F.array(*map(F.lit, _ODD)), (F.col("doc_id") % 12 + 1).cast("int")), F.lit("{}"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", P.checked_source_path(path).alias("plain"))


@plans.add("b24_join_doc_path", f"select id, case when id % 2 = 0 then '.vault/' || path else '.vault/' || path end as path from {VAULT_SQL}")
def doc_paths(spark, sf_dir):
    stored = F.when(F.col("id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit(".vault/"), F.col("path")))
    return vault(spark, sf_dir).select("id", P.under_docs(".vault/", stored).alias("path"))


_BODY = "concat('intro', chr(10), '# ', doc_type, ' ', id, case when id % 2 = 0 then concat(' | (**status:** `', case when status = '' then 'Accepted' else status end, '`)') else '' end, chr(10), '## more', chr(10), content)"


@plans.add("h15_h16_h17_title_status_feature", f"""select id, doc_type || ' ' || id as title, case when id % 2 = 0 then lower(case when status = '' then 'Accepted' else status end) else '' end as status, source as feature from {VAULT_SQL}""")
def titles(spark, sf_dir):
    v = vault(spark, sf_dir).withColumn("body", F.expr(_BODY))
    return v.select("id", T.title(F.col("body")).alias("title"), T.status(F.col("body")).alias("status"), T.feature(F.col("tags")).alias("feature"))


@plans.add("h18_body_first_line", f"select id, 3 + id % 4 as line from {VAULT_SQL}")
def body_lines(spark, sf_dir):
    v = vault(spark, sf_dir).filter(F.col("content").isNotNull())
    head = F.concat(F.lit("---\nx\n"), F.repeat(F.lit("\n"), (F.col("id") % 4).cast("int")))
    return v.select("id", T.body_line(F.concat(head, F.lit("\u0001"), F.col("content")), F.concat(F.lit("\u0001"), F.col("content"))).cast("long").alias("line"))


@plans.add("h21_h22_h23_embed_inputs", f"""select id, path || case when id % 2 = 0 then ' :: ' || source else '' end || ' :: ' || doc_type || chr(10) || lang as code,
  source || ' :: ' || doc_type || chr(10) || lang as document, case when id % 3 = 0 then lang else source || chr(10) || chr(10) || lang end as vault from {VAULT_SQL}""")
def embed_inputs(spark, sf_dir):
    v = vault(spark, sf_dir)
    even = F.when(F.col("id") % 2 == 0, F.col("source")).otherwise("")
    return v.select("id", T.code_input(F.col("path"), even, F.col("doc_type"), F.col("lang")).alias("code"), T.document_input(F.col("source"), F.col("doc_type"), F.lit(""), F.col("lang")).alias("document"), T.vault_input(F.when(F.col("id") % 3 == 0, "").otherwise(F.col("source")), F.col("lang")).alias("vault"))


@plans.add("b23_format_locator", f"""select id, case id % 5 when 0 then null when 1 then 'page ' || id when 2 then 'line ' || id || '-' || (id + 3) when 3 then 'sheet S' || id else 'none' end as locator from {VAULT_SQL}""")
def locators(spark, sf_dir):
    i = F.col("id") % 5
    kind = F.when(i == 1, "page").when(i == 2, "line").when(i == 3, "sheet").when(i == 4, "none")
    return vault(spark, sf_dir).select("id", T.locator(kind, F.when(i.isin(1, 2), F.col("id")), F.when(i == 3, F.concat(F.lit("S"), F.col("id").cast("string"))), F.when(i == 2, F.col("id") + 3), F.lit(None).cast("string")).alias("locator"))


@plans.add("h33_split_locator", f"""select id, case when id % 2 = 0 then id end as value_int, case when id % 2 = 1 then 'p' || id end as value_str from {VAULT_SQL}""")
def locator_split(spark, sf_dir):
    value = F.concat(F.when(F.col("id") % 2 == 1, "p").otherwise(""), F.col("id").cast("string"))
    return vault(spark, sf_dir).select("id", T.locator_parts(value).alias("p")).select("id", "p.*")


@plans.add("h03_force_split", "select doc_id, i as piece, md5(substr(text, i * 400 + 1, 500)) as digest from (select doc_id, text, unnest(range(0, (length(text) + 399) // 400)) as i from documents)")
def forced(spark, sf_dir):
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.fixed_windows(F.col("text"), 500, 100)).alias("piece", "chunk"))
    return pieces.select("doc_id", F.col("piece").cast("long").alias("piece"), F.md5("chunk").alias("digest"))


@plans.add("m06_m07_contains_evidence", r"""select d.doc_id, b.item_id from documents d join benchmark b on contains(lower(trim(regexp_replace(regexp_replace(d.text, '`|\*\*', '', 'g'), '\s+', ' ', 'g'))), lower(trim(regexp_replace(regexp_replace(b.text, '`|\*\*', '', 'g'), '\s+', ' ', 'g'))))""")
def evidence(spark, sf_dir):
    """Passages within documents. The benchmark is a query set of bounded size, met in blocks of all documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.evidence_text(F.col("text")).alias("t"))
    b = table(spark, sf_dir, "benchmark").select("item_id", T.evidence_text(F.col("text")).alias("e"))
    return d.join(checked_broadcast(b), F.contains(F.col("t"), F.col("e"))).select("doc_id", "item_id")


@plans.add("b27_classify_delta", f"""select kind, count(*) as n from (select case id % 6 when 0 then 'body' when 1 then 'unchanged' when 2 then 'body' when 3 then 'metadata' when 4 then 'unchanged' else 'body' end as kind from {VAULT_SQL}) group by kind""")
def deltas(spark, sf_dir):
    i = F.col("id") % 6
    v = vault(spark, sf_dir).filter(F.col("content").isNotNull())
    now = T.content_fingerprint(F.col("content"), F.col("content"), F.col("source"))
    before = (
        F.when(i == 1, now).when(i == 2, T.content_fingerprint(F.col("content"), F.lit("x"), F.col("source"))).when(i == 3, T.content_fingerprint(F.col("content"), F.col("content"), F.lit("x")))
        .when(i == 4, T.content_fingerprint(F.lit("x"), F.col("content"), F.col("source"))).when(i == 5, F.lit("old"))
    )
    return v.groupBy(T.change_kind(before, now).alias("kind")).agg(F.count("*").alias("n"))

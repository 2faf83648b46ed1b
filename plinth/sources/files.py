"""File sources: reading, admission, ignore rules, content hashes, routes and logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.paths import glob_regex

MAX_SOURCE_BYTES = 10 << 20
SNIFFED_BYTES = 8192
BATCH_FILES = 64
# Excluded always, after all ignore files, so that no negation brings them back; the last is the folder of the index's own data.
ALWAYS_IGNORED = (".venv/", ".git/", ".vault/", ".vaultspec/", "node_modules/", "__pycache__/", ".claude/worktrees/", ".vault/data/search-data/")
# Language and grammar (empty: none) by suffix.
PARSERS = {
    ".py": ("python", "python"),
    ".rs": ("rust", "rust"),
    ".md": ("markdown", ""),
    ".js": ("javascript", "javascript"),
    ".jsx": ("javascript", "javascript"),
    ".ts": ("typescript", "typescript"),
    ".tsx": ("typescript", "tsx"),
    ".go": ("go", "go"),
    ".java": ("java", "java"),
    ".c": ("c", "c"),
    ".h": ("c", "c"),
    ".cpp": ("cpp", "cpp"),
    ".hpp": ("cpp", "cpp"),
    ".cc": ("cpp", "cpp"),
    ".cs": ("csharp", "csharp"),
    ".rb": ("ruby", "ruby"),
    ".sh": ("shell", "bash"),
    ".bash": ("shell", "bash"),
    ".yaml": ("yaml", ""),
    ".yml": ("yaml", ""),
    ".toml": ("toml", ""),
    ".json": ("json", ""),
    ".html": ("html", ""),
    ".css": ("css", ""),
    ".kt": ("kotlin", "kotlin"),
    ".txt": ("text", ""),
    ".properties": ("text", ""),
    ".xml": ("xml", ""),
    ".xsd": ("xml", ""),
}
# Suffixes that the conventional profile takes as code.
CONVENTIONAL = (".bash", ".c", ".cc", ".cpp", ".cs", ".css", ".go", ".h", ".hpp", ".java", ".js", ".jsx", ".kt", ".py", ".rb", ".rs", ".sh", ".ts", ".tsx")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share; a local one only where that is unset in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    base = base or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/plinth-{uuid.uuid4().hex[:12]}"


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, modified, content) of files below root by their relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    below = F.regexp_replace(plain, "^.*?" + glob_regex(root.split(":", 1)[-1].rstrip("/")).removeprefix("^(?s:").removesuffix(")$").lstrip("/") + "/", "")
    return files.select(below.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """(key, content): Markdown records by their path without the suffix. Unreadable files are skipped where Spark is told to ignore them."""
    files = read_files(spark, root, "*.md")
    return files.select(F.regexp_replace("path", r"\.md$", "").alias("key"), F.decode("content", "UTF-8").alias("content"))


def front_matter(content: Column) -> tuple[Column, Column]:
    """(front matter, body); the first is empty where there is none."""
    block = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"
    return F.regexp_extract(content, block, 1), F.regexp_replace(content, block, "")


def front_field(front: Column, name: str) -> Column:
    """A scalar field of the front matter, without quotes, or null."""
    return F.nullif(F.regexp_extract(front, rf"(?m)^{name}:[ \t]*['\"]?(.*?)['\"]?[ \t]*$", 1), F.lit(""))


def front_list(front: Column, name: str) -> Column:
    """A list field, written in brackets or by dashes."""
    inline = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\[(.*)\]", 1)
    dashed = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[ \t]*.*\n?)+)", 1)
    items = F.when(inline != "", F.split(inline, ",")).otherwise(F.split(F.regexp_replace(dashed, r"(?m)^[ \t]*-[ \t]*", ""), "\n"))
    return F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")), lambda x: x != "")


def suffix(path: Column) -> Column:
    """The last suffix of the base name in lower case, with its dot; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^.+(\.[^.]+)$", 1))


def parser(path: Column) -> Column:
    """(language, grammar) by suffix; text and none for unknown ones."""
    s, language, grammar = suffix(path), F.lit("text"), F.lit(None).cast("string")
    for known, (lang, gram) in PARSERS.items():
        language = F.when(s == known, lang).otherwise(language)
        grammar = F.when(s == known, F.lit(gram or None).cast("string")).otherwise(grammar)
    return F.struct(language.alias("language"), grammar.alias("grammar"))


def ignore_rules(lines: Iterable[tuple[str, str]], extra: Iterable[str] = ()) -> list[tuple[str, bool]]:
    """(regular expression, negated) in order from (folder, line) of ignore files, extra patterns and ALWAYS_IGNORED last."""
    given = [(folder, line.rstrip()) for folder, line in lines] + [("", x) for x in extra] + [("", x) for x in ALWAYS_IGNORED]
    rules = []
    for folder, line in given:
        if not line or line.startswith("#"):
            continue
        negated, pattern = line.startswith("!"), line.removeprefix("!")
        prefix = f"{folder.strip('/')}/" if folder.strip("/") else ""
        inner = pattern.strip("/")
        anchored = "/" in inner or pattern.startswith("/")
        body = glob_regex(inner).removeprefix("^(?s:").removesuffix(")$").replace(".*.*", "\0").replace(".*", "[^/]*").replace("\0", ".*")
        rules.append((f"^{glob_regex(prefix).removeprefix('^(?s:').removesuffix(')$')}{'' if anchored else '(?:.*/)?'}{body}{'/' if pattern.endswith('/') else '(?:/|$)'}", negated))
    return rules


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for regex, negated in rules:
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def routed_kind(path: Column, routes: list[tuple[str, str]], transform: Column | None = None) -> Column:
    """The kind that all matching routes (glob, kind) and the transform's agree on; null without one, an error if they differ."""
    kinds = F.array_compact(F.array(*(F.when(path.rlike(glob_regex(g)), F.lit(k)) for g, k in routes), *([transform] if transform is not None else []), F.lit(None).cast("string")))
    kinds = F.array_distinct(kinds)
    return F.when(F.size(kinds) > 1, F.raise_error(F.concat(F.lit("conflicting owners of "), path)).cast("string")).otherwise(F.try_element_at(kinds, F.lit(1)))


def classify(path: Column, ignored: Column, routes: list[tuple[str, str]] = (), explicit_only: bool = False, transform: Column | None = None) -> Column:
    """(kind, admitted, reason): ignored, a route's, not routed, outside the source profile, or the profile's code."""
    kind = routed_kind(path, list(routes), transform)
    code = F.lit("code")

    def answer(k, admitted: bool, reason: str) -> Column:
        return F.struct(k.alias("kind"), F.lit(admitted).alias("admitted"), F.lit(reason).alias("reason"))

    none = F.lit(None).cast("string")
    rest = answer(none, False, "not_routed") if explicit_only else F.when(suffix(path).isin(*CONVENTIONAL), answer(code, True, "source_profile")).otherwise(answer(code, False, "source_profile_excluded"))
    return F.when(ignored, answer(none, False, "ignored")).when(kind.isNotNull(), answer(kind, True, "explicit_route")).otherwise(rest)


def is_binary(content: Column) -> Column:
    """A zero byte among the first ones."""
    return F.regexp_like(F.hex(F.substring(content, 1, SNIFFED_BYTES)), F.lit("^(?:..)*?00"))


def code_refusal(length: Column, content: Column, transformed: Column | None = None) -> Column:
    """source_too_large or source_binary, or null; files with a transform pass."""
    refused = F.when(length > MAX_SOURCE_BYTES, "source_too_large").when(is_binary(content), "source_binary")
    return F.when(~transformed, refused) if transformed is not None else refused


def dispositions(classified: DataFrame) -> DataFrame:
    """Counts by (kind, admitted, reason), in that order."""
    return classified.groupBy("kind", "admitted", "reason").agg(F.count("*").alias("n")).orderBy("kind", "admitted", "reason")


def match_rules(paths: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """(path, rule): the first rule that matches by priority, then by place. rules: (priority, glob, name)."""
    out = F.lit(None).cast("string")
    for _, _, glob, name in sorted(((p, i, g, n) for i, (p, g, n) in enumerate(rules)), reverse=True):
        out = F.when(F.col("path").rlike(glob_regex(glob)), F.lit(name)).otherwise(out)
    return paths.withColumn("rule", out)


def batches(paths: DataFrame, size: int = BATCH_FILES) -> DataFrame:
    """paths (path, rule) with their batch among those of the rule, in path order."""
    n = F.row_number().over(Window.partitionBy("rule").orderBy("path")) - 1
    return paths.withColumn("batch", F.floor(n / size).cast("int"))


def reusable_hash(length: Column, modified: Column, evidence_length: Column, evidence_modified: Column, hashed_at: Column, settle: float = 2.0) -> Column:
    """Whether a stored hash holds: same size and time, and hashed settle seconds after the file was written at least."""
    return F.coalesce((length == evidence_length) & (modified == evidence_modified) & (modified + settle <= hashed_at), F.lit(False))


def hash_paths(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """(path, digest, reused): stored hashes where they hold, else SHA-256 of the content. evidence: (path, length, modified, hashed_at, digest)."""
    e = evidence.select("path", F.col("length").alias("_l"), F.col("modified").alias("_m"), F.col("hashed_at").alias("_h"), F.col("digest").alias("_d"))
    joined = files.join(e, "path", "left").withColumn("reused", reusable_hash(F.col("length"), F.col("modified"), F.col("_l"), F.col("_m"), F.col("_h")))
    return joined.select("path", F.when(F.col("reused"), F.col("_d")).otherwise(F.sha2("content", 256)).alias("digest"), "reused")


def cached_outputs(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (key, identity, ...) with the cached output of equal key and identity; another identity under the key is a miss."""
    c = cache.select("key", F.col("identity").alias("_i"), "output")
    return wanted.join(c, (wanted["key"] == c["key"]) & (wanted["identity"] == c["_i"]), "left").select(*(wanted[x] for x in wanted.columns), "output")


def split_batch_output(batches_out: DataFrame, paths: DataFrame) -> DataFrame:
    """(batch, path, text, failed): a batch's JSON array by its elements' path. paths: (batch, path).

    An unreadable array fails all its paths, a missing or unreadable element its own; elements for other paths are left
    out, and of several for a path the last counts. batches_out: (batch, json).
    """
    read = batches_out.select("batch", F.from_json("json", "array<struct<path:string,text:string>>").alias("a"))
    items = read.select("batch", F.posexplode("a").alias("i", "e")).filter("e.path is not null")
    last = items.groupBy("batch", F.col("e.path").alias("path")).agg(F.max_by("e.text", "i").alias("text"))
    return paths.join(last, ["batch", "path"], "left").withColumn("failed", F.col("text").isNull())


def tail_lines(logs: DataFrame, by: str, limit: int) -> DataFrame:
    """The last limit lines of each log by seq."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))
    return logs.withColumn("_n", n).filter(F.col("_n") <= limit).drop("_n")


def match_lines(logs: DataFrame, contains: str | None = None, request_id: str | None = None) -> DataFrame:
    """Lines that hold contains, whatever the case, and request_id=... as a word."""
    if contains:
        logs = logs.filter(F.contains(F.lower("line"), F.lit(contains.lower())))
    if request_id:
        logs = logs.filter(F.col("line").rlike(rf"(?i)\brequest_id={glob_regex(request_id).removeprefix('^(?s:').removesuffix(')$')}\b"))
    return logs


def newest_within(logs: DataFrame, by: str, budget: int) -> DataFrame:
    """The longest run of newest lines of each log whose bytes, with line ends, stay within budget."""
    spent = F.sum(F.octet_length("line") + 1).over(Window.partitionBy(by).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return logs.withColumn("_b", spent).filter(F.col("_b") <= budget).drop("_b")

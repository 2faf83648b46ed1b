"""Path expressions: domains, locale variants, globs, identities. All are built-in column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains and the names that tell them.
DOMAINS = ("prod", "tests", "docs", "locale", "generated", "vendored", "worktree")
VENDORED_DIRS = ("node_modules", "vendor", "third_party", "thirdparty", ".venv", "venv", "site-packages", "bower_components", "dist", "build", ".tox", "eggs")
GENERATED_DIRS = ("__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "generated", "__generated__", ".next", ".nuxt")
GENERATED_NAMES = ("*.min.js", "*.min.css", "*_pb2.py", "*_pb2_grpc.py", "*.pb.go", "*.g.dart", "*.generated.*")
TEST_DIRS = ("tests", "test", "spec", "__tests__")
TEST_NAMES = ("test_*", "*_test.*", "*_spec.*", "conftest.py")
LOCALE_DIRS = ("locales", "locale", "i18n", "translations", "lang")
LOCALE_EXTENSIONS = ("yml", "yaml", "json", "po", "properties", "ini", "toml")
DOC_DIRS = ("docs", "doc")
DOC_NAMES = ("readme*", "changelog*", "license*")
DOC_EXTENSIONS = ("md", "rst", "adoc")
HIDDEN_DOMAINS = ("worktree", "generated")
DEMOTED_DOMAINS = ("tests", "docs", "locale", "vendored")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell pattern; * also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            inner = pattern[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"^(?s:{out})$"


def _any_glob(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """(segments, directory segments, lower-case base name) of a path with either kind of slash."""
    whole = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^/+|/+$", "")
    segments = F.filter(F.split(whole, "/"), lambda s, i: (whole != "") | (i < 0))
    return segments, F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), F.lower(F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("")))


def is_worktree(segments: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segments, "/"), F.lit("/")).rlike(r"/\.(claude|git)/worktrees/")


def is_locale(directories: Column, base: Column) -> Column:
    named = base.rlike(rf"^(?:[a-z]{{2}}|.*\.[a-z]{{2}})\.({'|'.join(LOCALE_EXTENSIONS)})$")
    return F.arrays_overlap(directories, F.array(*map(F.lit, LOCALE_DIRS))) | named


def is_docs(directories: Column, base: Column) -> Column:
    return F.arrays_overlap(directories, F.array(*map(F.lit, DOC_DIRS))) | _any_glob(base, DOC_NAMES) | base.rlike(rf"\.({'|'.join(DOC_EXTENSIONS)})$")


def classify_domain(path: Column) -> Column:
    """One of DOMAINS; the first that fits of worktree, vendored, generated, tests, locale and docs, else prod. A null path is prod."""
    segments, directories, base = path_parts(F.coalesce(path, F.lit("")))

    def inside(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(directories, F.array(*map(F.lit, names)))

    return (
        F.when(is_worktree(segments), "worktree")
        .when(inside(VENDORED_DIRS), "vendored")
        .when(inside(GENERATED_DIRS) | _any_glob(base, GENERATED_NAMES), "generated")
        .when(inside(TEST_DIRS) | _any_glob(base, TEST_NAMES), "tests")
        .when(is_locale(directories, base), "locale")
        .when(is_docs(directories, base), "docs")
        .otherwise("prod")
    )


def chunk_category(path: Column) -> Column:
    """prod, tests or docs: the domain for preference nudges."""
    domain = classify_domain(path)
    return F.when(domain.isin("tests", "docs"), domain).otherwise("prod")


def stored_domain(domain: Column, path: Column) -> Column:
    """The stored domain, or that of the path where none is stored."""
    return F.coalesce(F.when(domain != "", domain), classify_domain(path))


def locale_key(path: Column) -> Column:
    """What locale variants of a path share, or null: dir/<ll>.ext, dir/<ll>/name.ext or name.<ll>.ext."""
    ext = rf"\.((?i:{'|'.join(LOCALE_EXTENSIONS)}))$"
    alone = rf"^((?:.*/)?)[a-z]{{2}}{ext}"
    folder = rf"^((?:.*/)?)[a-z]{{2}}/([^/]*){ext}"
    middle = rf"^((?:.*/)?)([^/]*)\.[a-z]{{2}}{ext}"

    def start(prefix: Column) -> Column:  # "a/b/" as it is, "" as "/"
        return F.when(prefix == "", F.lit("/")).otherwise(prefix)

    return (
        F.when(path.rlike(alone), F.concat(start(F.regexp_extract(path, alone, 1)), F.lit("*."), F.regexp_extract(path, alone, 2)))
        .when(path.rlike(folder), F.concat(start(F.regexp_extract(path, folder, 1)), F.lit("*/"), F.regexp_extract(path, folder, 2), F.lit("."), F.regexp_extract(path, folder, 3)))
        .when(path.rlike(middle), F.concat(start(F.regexp_extract(path, middle, 1)), F.regexp_extract(path, middle, 2), F.lit(".*."), F.regexp_extract(path, middle, 3)))
    )


def expand_pattern(pattern: str) -> tuple[str, ...]:
    """A glob stands for itself; a plain path for itself and all beneath; an empty one for everything."""
    if any(c in pattern for c in "*?["):
        return (pattern,)
    plain = pattern.rstrip("/")
    return (plain, f"{plain}/*") if plain else ("*",)


def matches_any(path: Column, patterns: list[str]) -> Column:
    wide = [p for given in patterns for p in expand_pattern(given)]
    return F.coalesce(_any_glob(path, tuple(wide)), F.lit(False)) if wide else F.lit(False)


def path_filter(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    keep = matches_any(path, include) if include else F.lit(True)
    return keep & ~matches_any(path, exclude) if exclude else keep


def stable_id(name: Column) -> Column:
    """63 bits: the first 8 bytes of SHA-256, big-endian, without the highest bit."""
    hexed = F.sha2(name, 256)
    first = F.conv(F.conv(F.substring(hexed, 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(7)).cast("string"), 10, 16)
    return F.conv(F.concat(first, F.substring(hexed, 2, 15)), 16, 10).cast("long")


def root_prefix(root: Column) -> Column:
    """Namespace of a root: r, 12 hex digits of a hash of its normalised path, and an underscore."""
    return F.concat(F.lit("r"), F.substring(F.sha2(normal_path(root), 256), 1, 12), F.lit("_"))


def normal_path(path: Column) -> Column:
    """Forward slashes, no doubled or last ones, no dot segments."""
    slashed = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/+", "/")
    return F.regexp_replace(F.regexp_replace(slashed, r"(?<=^|/)\./", ""), "(?<=.)/$", "")


def checked_source_path(path: Column) -> Column:
    """The normalised path, or null for an empty, absolute or upward one."""
    plain = normal_path(path)
    return F.when((plain != "") & (plain != ".") & ~plain.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)"), plain)


def under_docs(prefix: str, path: Column) -> Column:
    """The path below prefix, which is put before it unless it is there."""
    plain, p = F.replace(path, F.lit("\\"), F.lit("/")), prefix.replace("\\", "/").rstrip("/")
    if not prefix:
        return path
    return F.when((plain == p) | plain.startswith(p + "/"), plain).otherwise(F.concat(F.lit(p + "/"), plain))


def resolve_noise(hide: tuple[str, ...] = HIDDEN_DOMAINS, demote: tuple[str, ...] = DEMOTED_DOMAINS, exclude: list[str] = (), only: list[str] = (), include: list[str] = ()) -> dict[str, frozenset[str]]:
    """Sets hide, only and demote: hidden wins over demoted, re-admitted over both; only may name any domain, the others all but prod."""

    def known(names, allowed) -> frozenset[str]:
        return frozenset(n.strip().lower() for n in names) & frozenset(allowed)

    noise = DOMAINS[1:]
    back = known(include, noise)
    hidden = (frozenset(hide) | known(exclude, noise)) - back
    return {"hide": hidden, "only": known(only, DOMAINS), "demote": frozenset(demote) - back - hidden}


def noise_sets(exclude: Column, only: Column, include: Column) -> dict[str, Column]:
    """resolve_noise() of array columns, row by row."""

    def known(names: Column, allowed: tuple[str, ...]) -> Column:
        return F.array_intersect(F.transform(names, lambda n: F.lower(F.trim(n))), F.array(*map(F.lit, allowed)))

    noise = DOMAINS[1:]
    back = known(include, noise)
    hide = F.array_except(F.array_union(F.array(*map(F.lit, HIDDEN_DOMAINS)), known(exclude, noise)), back)
    return {"hide": hide, "only": known(only, DOMAINS), "demote": F.array_except(F.array_except(F.array(*map(F.lit, DEMOTED_DOMAINS)), back), hide)}

"""Text expressions: query tokens, titles, statuses, embedding inputs, locators, identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query tokens and the filters they set; those in MULTIPLE accumulate.
TOKENS = {
    "type": "doc_type", "feature": "feature", "date": "date", "tag": "tag", "lang": "language", "path": "path_scope", "func": "function_name", "class": "class_name",
    "nodetype": "node_type", "intent": "intent", "status": "status", "exclude": "exclude_domain", "only": "only_domain", "include": "include_domain",
}
MULTIPLE = ("exclude_domain", "only_domain", "include_domain")
TOKEN_PATTERN = r"\b(type|feature|date|tag|lang|path|func|class|nodetype|intent|status|exclude|only|include):(\S+)"
# Record types, and the statuses of active decisions.
DOC_TYPES = ("adr", "audit", "exec", "plan", "reference", "research")
ACTIVE = ("accepted", "unknown")


def query_text(raw: Column) -> Column:
    """The query without its tokens, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, TOKEN_PATTERN, ""), r"\s+", " "))


def query_filter(raw: Column, token: str) -> Column:
    """The value of a token: the last one, or all of them by commas where they accumulate; null without one."""
    pairs = F.arrays_zip(F.regexp_extract_all(raw, F.lit(TOKEN_PATTERN), 1).alias("k"), F.regexp_extract_all(raw, F.lit(TOKEN_PATTERN), 2).alias("v"))
    own = F.transform(F.filter(pairs, lambda p: p["k"] == token), lambda p: p["v"])
    if TOKENS[token] in MULTIPLE:
        return F.when(F.size(own) > 0, F.array_join(own, ","))
    last = F.try_element_at(own, F.lit(-1))
    return F.regexp_replace(last, "^#+", "") if token == "tag" else last


def parse_query(raw: Column) -> Column:
    """A struct of text and one field by filter."""
    return F.struct(query_text(raw).alias("text"), *(query_filter(raw, t).alias(f) for t, f in TOKENS.items()))


def merged_domains(token: Column, explicit: list[str] | None) -> Column:
    """Explicit names, then the token's, each without outer space; null with neither."""
    own = F.filter(F.transform(F.split(token, ","), lambda x: F.trim(x)), lambda x: x != "")
    if explicit is None:
        return own
    return F.concat(F.array(*map(F.lit, explicit)), F.coalesce(own, F.array().cast("array<string>")))


def first_heading(body: Column) -> Column:
    """The text of the first line that starts with "# ", or empty."""
    lines = F.transform(F.split(body, r"\r\n|\n|\r"), lambda x: F.trim(x))
    return F.coalesce(F.trim(F.substring(F.try_element_at(F.filter(lines, lambda x: x.startswith("# ")), F.lit(1)), 3, 1 << 30)), F.lit(""))


def title(body: Column) -> Column:
    """The first heading without a status marker at its end."""
    return F.trim(F.regexp_replace(first_heading(body), r"\s*\|?\s*\(\*\*status:\*\*\s*`?[^`)]*`?\s*\)\s*$", ""))


def status(body: Column) -> Column:
    """The status marked in the first heading, lower case, or empty."""
    return F.lower(F.regexp_extract(first_heading(body), r"(?i)\(\*\*status:\*\*\s*`?([A-Za-z_-]+)`?", 1))


def feature(tags: Column) -> Column:
    """The first tag that isn't a record type, without #."""
    other = F.filter(tags, lambda t: ~F.lower(F.regexp_replace(t, "^#+", "")).isin(*DOC_TYPES))
    return F.coalesce(F.regexp_replace(F.try_element_at(other, F.lit(1)), "^#+", ""), F.lit(""))


def body_line(content: Column, body: Column) -> Column:
    """The line, from 1, at which body starts within content (1 if it isn't there)."""
    at = F.instr(content, body)
    return F.when((body == "") | (at < 1), F.lit(1)).otherwise(F.size(F.split(F.substring(content, F.lit(1), at), "\n", -1)))


def code_input(path: Column, class_name: Column, function_name: Column, content: Column) -> Column:
    return F.concat(F.concat_ws(" :: ", path, F.when(class_name != "", class_name), F.when(function_name != "", function_name)), F.lit("\n"), content)


def document_input(source: Column, title: Column, section: Column, content: Column) -> Column:
    return F.concat(F.concat_ws(" :: ", source, F.when(title != "", title), F.when(section != "", section)), F.lit("\n"), content)


def vault_input(title: Column, content: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", content).otherwise(F.concat(title, F.lit("\n\n"), content))


def locator(kind: Column, value_int: Column, value_str: Column, end_int: Column, end_str: Column) -> Column:
    """kind, "kind value" or "kind value-end"; null without a kind."""
    value = F.coalesce(value_int.cast("string"), F.when(value_str != "", value_str))
    end = F.coalesce(end_int.cast("string"), F.when(end_str != "", end_str))
    return F.when(F.coalesce(kind, F.lit("")) != "", F.concat(kind, F.coalesce(F.concat(F.lit(" "), value, F.coalesce(F.concat(F.lit("-"), end), F.lit(""))), F.lit(""))))


def locator_parts(value: Column) -> Column:
    """(whole number or null, text or null) of a locator's value."""
    number = F.when(value.rlike(r"^-?\d{1,18}$"), value.try_cast("long"))
    return F.struct(number.alias("value_int"), F.when(number.isNull(), value).alias("value_str"))


def active_status(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.when(value != "", value), F.lit("unknown")))).isin(*ACTIVE)


def evidence_text(text: Column) -> Column:
    """Lower case, without back-quotes and bold marks, with single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"`|\*\*", ""), r"\s+", " ")))


def fixed_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of size characters, each size - overlap further."""
    step = max(1, size - overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)))
    return F.coalesce(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size))), F.array().cast("array<string>"))


def canonical_json(*fields: Column) -> Column:
    """Compact JSON; fields go in the order given, which callers sort by name."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def fragment_id(path: Column, ordinal: Column, fingerprint: Column, where: Column, fragment: Column) -> Column:
    """Identity of a document fragment: d_ and 40 hex digits."""
    return F.concat(F.lit("d_"), F.sha1(canonical_json(fingerprint.alias("fingerprint"), fragment.alias("fragment"), where.alias("locator"), ordinal.alias("ordinal"), path.alias("path"), F.lit(2).alias("version"))))


def content_fingerprint(raw: Column, body: Column, metadata: Column) -> Column:
    """v2|raw|body|metadata; line ends don't count in the body."""
    return F.concat_ws("|", F.lit("v2"), F.sha2(raw, 256), F.sha2(F.regexp_replace(body, r"\r\n?", "\n"), 256), F.sha2(metadata, 256))


def change_kind(before: Column, now: Column) -> Column:
    """body, metadata or unchanged, by two fingerprints. Unknown or unreadable ones ask for the body."""
    a, b = F.split(before, r"\|"), F.split(now, r"\|")

    def readable(parts: Column) -> Column:
        return (F.size(parts) == 4) & (F.get(parts, 0) == "v2")

    return (
        F.when(before.isNull(), "body").when(before == now, "unchanged").when(~readable(a) | ~readable(b), "body")
        .when(F.get(a, 2) != F.get(b, 2), "body").when(F.get(a, 3) != F.get(b, 3), "metadata").otherwise("unchanged")
    )

"""User extractors: rules, approval, running, and the contract of their output."""

from __future__ import annotations

import hashlib
import importlib
import json
import subprocess
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits of an extractor's output.
MAX_UNITS, MAX_TEXT, MAX_FIELDS, MAX_METADATA, MAX_UNIT_METADATA = 100_000, 1_000_000, 256, 64 << 10, 16 << 10
SCHEMA_VERSION = 1
MAX_EMITTED = 64 << 20
KINDS = ("byte", "page", "sheet", "line", "char", "none")


class OutputError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    """Files that match pattern go to command ({path} or {paths} stand for them) or to entry_point (module:callable)."""

    pattern: str
    name: str
    command: tuple[str, ...] = ()
    entry_point: str = ""
    priority: int = 0
    target: str = "document"
    version: str = "1"
    timeout: float = 60.0
    batch: bool = False
    on_error: str = "skip"
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if bool(self.command) == bool(self.entry_point):
            raise OutputError(f"rule {self.name} wants a command or an entry point, and one of them")
        if self.on_error not in ("skip", "passthrough", "fail") or self.target not in ("document", "code"):
            raise OutputError(f"rule {self.name} has an unknown target or on_error")

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps([asdict(self), SCHEMA_VERSION], sort_keys=True).encode()).hexdigest()


def policy_digest(rules: list[Rule]) -> str:
    return hashlib.sha256("".join(r.fingerprint() for r in rules).encode()).hexdigest()


def approved(digests: set[str], rules: list[Rule]) -> bool:
    """User code runs only if just these rules were approved."""
    return policy_digest(rules) in digests


def checked_output(payload: object) -> dict:
    """The output if it keeps to the contract: one of units and text, known locators, and all sizes within their limits."""
    if not isinstance(payload, dict) or payload.get("schema_version") != SCHEMA_VERSION:
        raise OutputError("unknown schema version")
    units, text, metadata = payload.get("units"), payload.get("text"), payload.get("metadata") or {}
    if (units is None) == (text is None):
        raise OutputError("one of units and text is wanted")
    if not isinstance(metadata, dict) or len(metadata) > MAX_FIELDS or len(json.dumps(metadata)) > MAX_METADATA:
        raise OutputError("metadata is too large")
    units = units if units is not None else [{"text": text}]
    if not isinstance(units, list) or len(units) > MAX_UNITS:
        raise OutputError("too many units")
    for u in units:
        if not isinstance(u, dict) or not isinstance(u.get("text"), str) or len(u["text"]) > MAX_TEXT:
            raise OutputError("a unit has no text, or too much of it")
        where = u.get("locator")
        if where is not None and (not isinstance(where, dict) or where.get("kind") not in KINDS):
            raise OutputError("a unit has an unknown locator")
        if len(json.dumps(u.get("metadata") or {})) > MAX_UNIT_METADATA:
            raise OutputError("a unit's metadata is too large")
    return {"units": units, "metadata": metadata}


def _entry(name: str):
    module, _, call = name.partition(":")
    return getattr(importlib.import_module(module), call)


def run_rule(rule: Rule, path: str, content: bytes, most: int = MAX_EMITTED) -> tuple[str, dict | None, str]:
    """(ok, skipped, passthrough or failed; output; cause). Causes in order: output over most, exit, JSON, contract, emitted text over most."""
    try:
        if rule.entry_point:
            payload = _entry(rule.entry_point)(path, content, **rule.options)
        else:
            done = subprocess.run([a.replace("{path}", path) for a in rule.command], input=content, capture_output=True, timeout=rule.timeout, check=False)
            if len(done.stdout) > most:
                raise OutputError("output over the limit")
            if done.returncode:
                raise OutputError(f"exit {done.returncode}")
            payload = json.loads(done.stdout)
        out = checked_output(payload)
        if sum(len(u["text"].encode()) for u in out["units"]) > most:
            raise OutputError("text over the limit")
        return "ok", out, ""
    except (OutputError, OSError, subprocess.TimeoutExpired, ValueError) as e:
        return {"skip": "skipped", "passthrough": "passthrough", "fail": "failed"}[rule.on_error], None, str(e)[:200]


def extract(files: DataFrame, rules: list[Rule], digests: set[str], cache: DataFrame | None = None) -> DataFrame:
    """(path, state, ordinal, text, title, section, cause): units of files (path, content, rule) by their rule; cached outputs of equal identity aren't run again.

    cache: (key, identity, output) with output the units as JSON; the key is the hash of path and content.
    """
    if not approved(digests, rules):
        raise PermissionError("these extractor rules aren't approved")
    by_name = {r.name: r for r in rules}
    identity = F.create_map(*(x for r in rules for x in (F.lit(r.name), F.lit(r.fingerprint()))))
    keyed = files.withColumns({"key": F.sha2(F.concat(F.encode("path", "UTF-8"), F.col("content")), 256), "identity": identity[F.col("rule")]})
    if cache is not None:
        from plinth.sources.files import cached_outputs

        keyed = cached_outputs(keyed, cache)
    else:
        keyed = keyed.withColumn("output", F.lit(None).cast("string"))
    names = ["path", "state", "ordinal", "text", "title", "section", "cause"]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, rule, known in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                state, out, cause = ("ok", {"units": json.loads(known)}, "") if known is not None else run_rule(by_name[rule], path, content)
                for i, u in enumerate(out["units"] if out else [{}]):
                    rows.append((path, state, i, u.get("text"), u.get("title"), u.get("section"), cause))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return keyed.select("path", "content", "rule", "output").mapInArrow(run, "path string, state string, ordinal int, text string, title string, section string, cause string")


def run_batch(rule: Rule, paths: list[str], contents: list[bytes], most: int = MAX_EMITTED) -> list[tuple[str, dict | None, str]]:
    """One run for several files: the command gets a manifest [{"path", "text"}] and prints an array of outputs with their path.

    If the array can't be read all files fail, else each one whose element is missing or breaks the contract; of several
    elements for a path the last counts.
    """
    failed = {"skip": "skipped", "passthrough": "passthrough", "fail": "failed"}[rule.on_error]
    manifest = json.dumps([{"path": p, "text": c.decode("utf-8", "replace")} for p, c in zip(paths, contents, strict=True)])
    try:
        done = subprocess.run(list(rule.command), input=manifest.encode(), capture_output=True, timeout=rule.timeout, check=False)
        if len(done.stdout) > most or done.returncode:
            raise OutputError("output over the limit" if not done.returncode else f"exit {done.returncode}")
        got = json.loads(done.stdout)
        if not isinstance(got, list):
            raise OutputError("no array")
    except (OutputError, OSError, subprocess.TimeoutExpired, ValueError) as e:
        return [(failed, None, str(e)[:200]) for _ in paths]
    last = {x["path"]: x for x in got if isinstance(x, dict) and isinstance(x.get("path"), str)}
    out = []
    for p in paths:
        try:
            out.append(("ok", checked_output(last.get(p)), ""))
        except OutputError as e:
            out.append((failed, None, str(e)))
    return out


def extract_batches(files: DataFrame, rules: list[Rule], digests: set[str]) -> DataFrame:
    """(path, state, ordinal, text, cause) of files (path, content, rule, batch): one run a batch (see files.batches), batches on the executors."""
    if not approved(digests, rules):
        raise PermissionError("these extractor rules aren't approved")
    by_name = {r.name: r for r in rules}

    def run(table: pa.Table) -> pa.Table:
        paths = table["path"].to_pylist()
        rows = [(p, state, i, u.get("text"), cause) for p, (state, out, cause) in zip(paths, run_batch(by_name[table["rule"][0].as_py()], paths, table["content"].to_pylist()), strict=True) for i, u in enumerate(out["units"] if out else [{}])]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "state", "ordinal", "text", "cause"])

    return files.groupBy("rule", "batch").applyInArrow(run, "path string, state string, ordinal int, text string, cause string")


def headroom(new_points: int, free_bytes: int, per_point: int = 16 << 10, reserve: int = 1 << 30) -> bool:
    """Whether a write of so many points leaves the reserve free."""
    return new_points * per_point + reserve <= free_bytes

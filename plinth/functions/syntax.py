"""Definitions of languages with braces: a lexer that blanks strings and comments, and units by nesting.

A file is cut into units, each a definition with what stands before it, or other text up to the next one; a unit ends with
the brace that closes its block, or with a semicolon or an empty line outside of all brackets. All text is in some unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

# Comment and string forms by language, and words that begin definitions.
LANGUAGES = ("javascript", "typescript", "go", "rust", "java", "c", "cpp", "csharp", "kotlin", "swift", "php")
QUOTES = {"javascript": "'\"`", "typescript": "'\"`", "go": "'\"`", "rust": '"', "java": "'\"", "c": "'\"", "cpp": "'\"", "csharp": "'\"", "kotlin": "'\"", "swift": '"', "php": "'\""}
CONTAINERS = ("class", "interface", "enum", "record", "struct", "trait", "impl", "module", "mod", "namespace", "object", "union", "extension", "protocol", "type")
FUNCTIONS = ("function", "func", "fn", "fun")
NO_NAMES = ("if", "for", "while", "switch", "catch", "return", "else", "do", "try", "match", "loop", "select", "when", "synchronized", "sizeof", "new", "with", "foreach", "guard")

_WORD = r"[A-Za-z_$][\w$]*"
_CONTAINER = re.compile(rf"\b({'|'.join(CONTAINERS)})\b(?:\s*<[^{{}};]*?>)?\s+(?:class\s+)?({_WORD})?")
_IMPL = re.compile(rf"\bimpl\b(?:\s*<[^{{}};]*?>)?\s+(?:[\w:<>,&' ]+?\s+for\s+)?({_WORD})")
_NAMED_FUNCTION = re.compile(rf"\b(?:{'|'.join(FUNCTIONS)})\b\s*\*?\s*(?:\([^(){{}}]*\)\s*|<[^(){{}}]*?>\s*)?({_WORD})")
_ASSIGNED = re.compile(rf"\b(?:const|let|var)\s+({_WORD})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\(|{_WORD}\s*=>)")
_CALLABLE = re.compile(rf"({_WORD})\s*(?:<[^(){{}}]*>)?\s*\([^{{}};]*\)\s*(?:[\w\s:<>,.&*\[\]?|-]|=>)*$")
_DOC_STRING = re.compile(r'"""')


class Unit(NamedTuple):
    start: int
    end: int
    node: str | None
    function: str | None
    owner: str | None
    body: int | None  # where the text behind the opening brace begins


def blanked(source: str, language: str) -> str:
    """source with all but line ends of comments, strings and preprocessor lines as spaces: of the same length."""
    quotes, out, i, n = QUOTES[language], list(source), 0, len(source)

    def blank(a: int, b: int) -> int:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "
        return b

    def closed(at: int, end: str, escapes: bool = True) -> int:
        while at < n:
            if escapes and source[at] == "\\":
                at += 2
            elif source.startswith(end, at):
                return at + len(end)
            else:
                at += 1
        return n

    while i < n:
        c = source[i]
        if source.startswith("//", i) or c == "#" and language == "php":
            stop = source.find("\n", i)
            i = blank(i, n if stop < 0 else stop)
        elif source.startswith("/*", i):
            depth, at = 1, i + 2
            while at < n and depth:
                if source.startswith("*/", at):
                    depth, at = depth - 1, at + 2
                elif language in ("rust", "swift", "kotlin") and source.startswith("/*", at):
                    depth, at = depth + 1, at + 2
                else:
                    at += 1
            i = blank(i, at)
        elif c == "#" and language in ("c", "cpp", "csharp") and not source[source.rfind("\n", 0, i) + 1 : i].strip():
            at = i
            while True:
                stop = source.find("\n", at)
                if stop < 0 or source[stop - 1] != "\\":
                    break
                at = stop + 1
            i = blank(i, n if stop < 0 else stop)
        elif language == "rust" and (raw := re.compile(r'b?r(#*)"').match(source, i)) and not (i and (source[i - 1].isalnum() or source[i - 1] == "_")):
            i = blank(i, closed(raw.end(), '"' + raw[1], False))
        elif language == "rust" and c == "'":
            char = re.compile(r"'(?:\\[^\n]{1,8}?|[^\\'\n])'").match(source, i)  # else a lifetime
            i = blank(i, char.end()) if char else i + 1
        elif language in ("kotlin", "swift", "java") and _DOC_STRING.match(source, i):
            i = blank(i, closed(i + 3, '"""', language != "kotlin"))
        elif c in quotes:
            i = blank(i, closed(i + 1, c, not (c == "`" and language == "go")))
        elif c == "/" and language in ("javascript", "typescript") and re.search(r"(?:^|[=(,:;!&|?{}\n]|\breturn)\s*$", source[max(0, i - 40) : i]):
            line = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(source, i)
            i = blank(i, line.end()) if line else i + 1
        else:
            i += 1
    return "".join(out)


def _named(head: str, language: str) -> tuple[str | None, str | None, str | None]:
    """(node, function, class) of what stands before a block."""
    if m := _NAMED_FUNCTION.search(head):
        return "function", m[1], None
    if language in ("javascript", "typescript") and (m := _ASSIGNED.search(head)):
        return "function", m[1], None
    if language == "rust" and (m := _IMPL.search(head)):
        return "impl", None, m[1]
    if (m := _CONTAINER.search(head)) and (m[2] or m[1] in ("namespace", "enum", "struct", "union")) and "(" not in head[: m.start()]:
        return m[1], None, m[2]
    if (m := _CALLABLE.search(head.rstrip())) and m[1] not in NO_NAMES:
        return "function", m[1], None
    return None, None, None


def units(source: str, language: str, start: int = 0, end: int | None = None, plain: str | None = None) -> Iterator[Unit]:
    """The units of source from start to end, which lie one after another."""
    plain = blanked(source, language) if plain is None else plain
    end = len(source) if end is None else end
    at, begin, round_, block, opened = start, start, 0, 0, None
    while at < end:
        c = plain[at]
        if c in "([":
            round_ += 1
        elif c in ")]":
            round_ = max(0, round_ - 1)
        elif c == "{":
            if not block and not round_:
                opened = at
            block += 1
        elif c == "}" and block:
            block -= 1
            if not block and not round_ and opened is not None:
                stop = at + 1
                while stop < end and plain[stop] in " \t;,)":
                    stop += 1
                stop += stop < end and plain[stop] == "\n"
                node, function, owner = _named(plain[begin:opened], language)
                yield Unit(begin, stop, node, function, owner, opened + 1)
                at, begin, opened = stop, stop, None
                continue
        elif not block and not round_ and plain[begin:at].strip() and (c == ";" or c == "\n" and plain.startswith("\n", at + 1)):
            stop = at + 1
            while stop < end and plain[stop] in " \t":
                stop += 1
            stop += stop < end and plain[stop] == "\n"
            yield Unit(begin, stop, None, None, None, None)
            at, begin = stop, stop
            continue
        at += 1
    if begin < end:
        yield Unit(begin, end, None, None, None, None)

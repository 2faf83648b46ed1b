"""Definitions of languages with braces: names, ranges, and every character kept."""

import random

import pytest

from plinth.functions import chunk as K
from plinth.functions import syntax as S

CASES = {
    "javascript": ("""import x from 'y';

// a { comment
export async function load(a, b = {}) {
  const s = `t ${ '}' } {`;
  return /[{]/.test(a) ? "}" : b;
}

class Cache extends Base {
  get(key) { return this.m[key]; }
}
const put = (k, v) => { m[k] = v; };
let n = 1;
""", [("function", "load", None), ("class", None, "Cache"), ("function", "put", None)]),
    "go": ("""package main

import "fmt"

type Store struct {
\tm map[string]int
}

func (s *Store) Get(k string) (int, error) {
\tif v, ok := s.m[k]; ok { return v, nil }
\treturn 0, fmt.Errorf(`}{`)
}

func main() {}
""", [("type", None, "Store"), ("function", "Get", None), ("function", "main", None)]),
    "rust": ("""use std::fmt;

/* outer /* inner } */ still */
pub struct Point<'a> { name: &'a str, x: char }

impl<'a> fmt::Display for Point<'a> {
    fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result { write!(f, r#"{"}"#) }
}

pub trait Shape { fn area(&self) -> f64; }
fn quote() -> char { '{' }
""", [("struct", None, "Point"), ("impl", None, "Point"), ("trait", None, "Shape"), ("function", "quote", None)]),
    "java": ("""package a.b;

public class Index<T> implements Runnable {
    private final String s = "}";
    /** { */
    public <K> List<K> find(Map<String, K> m, int n) throws IOException {
        for (int i = 0; i < n; i++) { run(); }
        return null;
    }
}

enum Kind { A, B }
""", [("class", None, "Index"), ("enum", None, "Kind")]),
    "c": ("""#include <x.h>
#define OPEN {  \\
  more {

struct node { int v; struct node *next; };

static int add(int a, int b)
{
    /* } */
    return a + b + '}';
}
""", [("struct", None, "node"), ("function", "add", None)]),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_definitions(language):
    source, want = CASES[language]
    found = list(S.units(source, language))
    assert [(u.node, u.function, u.owner) for u in found if u.node] == want
    assert "".join(source[u.start : u.end] for u in found) == source
    for u in found:
        if u.node:
            body = source[u.start : u.end]
            assert S.blanked(source, language)[u.start : u.end].count("{") == S.blanked(source, language)[u.start : u.end].count("}") > 0 and body.rstrip().endswith(("}", "};"))


@pytest.mark.parametrize("language", sorted(CASES))
def test_chunks_keep_every_character(language):
    source, want = CASES[language]
    for most in (40, 120, 400, 5000):
        pieces = K.brace_chunks(source, language, most)
        assert "".join(p.text for p in pieces) == source
        at = 0
        for p in pieces:
            assert p.line_start == 1 + source.count("\n", 0, at)
            at += len(p.text)
            assert p.line_end <= 1 + source.count("\n", 0, at)
    names = {p.function for p in K.brace_chunks(source, language, 200)} | {p.owner for p in K.brace_chunks(source, language, 200)}
    assert {f or o for _, f, o in want} & names


def test_long_containers_are_opened():
    body = "".join(f"  m{i}(a) {{\n    return {'x' * 60};\n  }}\n\n" for i in range(30))
    chunks = K.code_chunks(f"class Big {{\n{body}}}\n", "a.js", "javascript")
    assert {c["class_name"] for c in chunks} == {"Big"} and {c["function_name"] for c in chunks} >= {"m0", "m29"}
    assert all(len(c["content"]) <= K.SYNTAX_CHARS for c in chunks)


def test_any_text_is_kept():
    r = random.Random(7)
    parts = ["{", "}", "(", ")", ";", "\n", "\n\n", '"', "'", "`", "/*", "*/", "//", "class A ", "function f", "fn g() ", "x = 1", "\\", "#", "r#\"", " "]
    for _ in range(400):
        source = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        for language in S.LANGUAGES:
            assert "".join(source[u.start : u.end] for u in S.units(source, language)) == source
            assert len(S.blanked(source, language)) == len(source)
            assert "".join(p.text for p in K.brace_chunks(source, language, 25)) == source

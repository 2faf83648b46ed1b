import math
import random

import pytest

from plinth.functions import chunk as K
from plinth.functions import encode as E
from plinth.operators import judge as J
from plinth.operators import schema as M
from plinth.sources import preprocess as X
from plinth.streaming import machines as S


def test_split_keeps_all_text():
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(["a", "bb ", " ", "\n", "\n\n", "\nclass ", "é", "\ndef f"]) for _ in range(r.randint(0, 120)))
        for lang in ("text", "python", "markdown"):
            pieces = K.split_text(text, 20, 0, lang)
            at = K.offsets_of(text, pieces)
            assert all(len(p) <= 20 for p in pieces)
            gaps = [text[a + len(p) : b] for a, p, b in zip(at, pieces, [*at[1:], len(text)], strict=bool(text))]
            assert all(not g.strip("\n #adefclst") for g in gaps)


def test_split_overlap():
    assert K.split_text("aaaa bbbb cccc", 9, 2) == ["aaaa bbbb", "bb cccc"]
    assert K.split_text("x" * 10, 4, 1) == ["xxxx", "xxxx", "xxxx", "x"]
    assert K.split_text("") == []


def test_markdown_sections_and_passages():
    text = "# Title\nintro line\n\n## One\ntext a\n\n```\n# no heading\n\n```\n\nSub\n---\nmore\n\n***\n\nlast"
    m = K.Markdown(text, first_line=5)
    assert [(p.section, text[p.start : p.end]) for p in m.passages] == [("", "intro line"), ("One", "text a\n\n```\n# no heading\n\n```"), ("Sub", "more"), ("Sub", "last")]
    assert m.passages[0].line_start == 6
    assert m.section_at(text.index("text a")) == "One" and m.section_at(text.index("## One")) == ""
    assert m.clip(text.index("line"), text.index("line") + 4)[0][:2] == (0, 4)
    long = " ".join(f"Sentence {i} here." for i in range(300))
    assert all(p.end - p.start <= K.PASSAGE_CHARS for p in K.Markdown(long).passages)
    assert K.split_record("")[0]["content"] == ""


def sections_by_hand(text):
    """The section of each character of a body without fences and underlined headings."""
    out, path, first = [], [], True
    for line in text.split("\n"):
        name = " > ".join(t for _, t in path)
        if line.startswith("#"):
            level = len(line) - len(line.lstrip("#"))
            if not (first and level == 1):
                path = [x for x in path if x[0] < level] + [(level, line.strip("# "))]
            first = False
        out += [name] + [" > ".join(t for _, t in path)] * len(line)
    return out


def test_markdown_on_random_bodies():
    """Passages cover the words outside headings and breaks, once, in order, within bounds and sections."""
    r = random.Random(12)
    for _ in range(300):
        lines = [r.choice(["word here. More of it", "- item one", "2) second", "", "", "## H" + r.choice("ab"), "### Deep ##", "# Top", "***", "x" * 30, "a b c! d? e"]) for _ in range(r.randint(1, 25))]
        text = "\n".join(lines)
        m = K.Markdown(text, 1, most=40, merge_below=12)
        covered = "".join("".join(text[p.start : p.end].split()) for p in m.passages)
        assert covered == "".join("".join(x.split()) for x in lines if not x.startswith("#") and x != "***")
        want = sections_by_hand(text)
        for p in m.passages:
            assert p.end - p.start <= 40 and text[p.start : p.end] == text[p.start : p.end].strip()
            assert p.section == want[p.start] and p.line_start == 1 + text.count("\n", 0, p.start) and p.line_end == 1 + text.count("\n", 0, p.end)
            assert m.section_at(p.start) == p.section
        for a, b in zip(m.passages, m.passages[1:], strict=False):
            assert a.end <= b.start


def test_markdown_lines():
    from plinth.functions import markdown as M

    assert [M.name_line(x).kind for x in ("", "  ", "- - -", "--", "***", "# a", "#a", "    # a", "```py", "~~", "####### x")] == ["blank", "blank", "break", "text", "break", "heading", "text", "text", "fence", "text", "text"]
    assert [M.name_line(x).value for x in ("# a #", "## a#", "# #", "#", "### b ## ")] == ["a", "a#", "", "", "b"]
    assert [M.is_item(x) for x in ("- a", "-", "1. a", "1234567890. a", "    - a", "+a", "12) x")] == [True, True, True, False, False, False, True]
    assert [M.underline(x) for x in ("===", "--", "=-", "    ---", "- -")] == [1, 2, 0, 0, 0]
    body = "Sub\n---\na\nb\n---\nc\n===\n- i\n---\n````\n```\n````\nend"
    m = K.Markdown(body, most=1000, merge_below=0)
    assert [(p.section, body[p.start : p.end]) for p in m.passages] == [("Sub", "a\nb"), ("c", "- i"), ("c", "````\n```\n````"), ("c", "end")]


def test_html():
    assert K.html_text("<template><p>x</template>a<br/>b<script>1 < 2</script></style>c<ul><li>d<li> e </ul>") == "a\n\nbc\n\nd\ne"
    assert K.html_text("<html><head><title>x</title></head><body><p>a &amp; b</p><script>z</script><div>c</div></body>") == "a & b\n\nc"
    assert K.html_text("") == ""


def test_syntax_chunks():
    source = "import os\n\n\ndef f(x):\n    return x\n\n\nclass A:\n    def m(self):\n        return 1\n"
    chunks = K.code_chunks(source, "a.py", "python")
    assert "".join(c["content"] for c in chunks).replace("\n", "") == source.replace("\n", "")
    wide = "class B:\n" + "".join(f"    def m{i}(self):\n        return '{'x' * 300}'\n\n" for i in range(12))
    parts = K.syntax_chunks(wide)
    assert all(len(p.text) <= K.SYNTAX_CHARS for p in parts) and {p.owner for p in parts} == {"B"}
    assert K.code_chunks("def broken(:\n", "b.py", "python")[0]["node_type"] is None
    a, b = K.Piece("a", 1, 1, "X", None, "A"), K.Piece("b", 2, 2, "F", "f", "B")
    assert K.joined(a, b)[3:] == ("F", "f", "B")


def test_packing_and_buckets():
    assert K.pack_greedy([3, 3, 3, 9, 1], 2, 6) == [0, 0, 1, 2, 3]
    got = K.encode_buckets(["a" * 40, "a" * 40, "a" * 400], token_budget=100, most_items=9)
    assert got == [0, 0, 1]


def test_encoder():
    v = E.hashed_encoder(["a b", "", "a b"])
    assert math.isclose(float((v[0] ** 2).sum()), 1, rel_tol=1e-6) and not v[1].any() and (v[0] == v[2]).all()
    assert E.query_vector("a b") == tuple(float(x) for x in v[0])


def test_retry_and_circuit():
    s = S.Retry()
    assert s.admit(0.0) == (True, s)
    for i in range(3):
        s = s.failed(100.0 * i)
    assert s.circuit == "open" and s.retry_at == 200.0 + 120.0
    assert not s.admit(300.0)[0]
    ok, half = s.admit(321.0)
    assert ok and half.circuit == "half_open" and not half.admit(400.0)[0]
    assert half.failed(330.0).circuit == "open" and half.succeeded() == S.Retry()
    assert S.Retry().failed(0.0, retryable=False).circuit == "open"


def test_pressure_hysteresis():
    p = S.Pressure()
    for t, raw in enumerate((2, 1, 2)):
        p = p.sample(raw, 5.0 * t)
    assert p.tier == 1
    for t in range(3, 14):
        p = p.sample(0, 5.0 * t)
        assert p.tier == 1
    assert p.sample(0, 70.0).tier == 1 and p.sample(0, 75.0).tier == 0
    assert p.sample(2, 66.0) == p  # too soon after the last one
    assert p.stale(80.0) and not p.stale(79.0) and p.stale(60.0)
    assert p.sample(1, 80.0).tier == 0  # lapsed


def test_scope():
    s = S.Scope().observe("a", 0.0, 5.0).observe("b", 3.0, 5.0)
    assert s.evaluate(4.0) == "collecting" and s.evaluate(8.0) == "ready"
    assert s.evaluate(8.0, pressure=2) == "pressure_hold" and s.evaluate(8.0, S.Retry(retry_at=9.0)) == "retry_wait"
    run = s.start().observe("c", 10.0, 5.0)
    assert run.captured == {"a", "b"} and run.evaluate(99.0) == "running"
    done = run.complete(20.0, 30.0)
    assert done.evaluate(40.0) == "cooling" and done.evaluate(60.0) == "ready"
    assert run.release(20.0).pending == {"a", "b", "c"}
    assert S.Activity().move("active").move("failed").move("succeeded").state == "failed"
    r = S.Revisions()
    assert (r.publish("x", "vault"), r.publish("x", "vault", 7), r.current("x", "code")) == (1, 8, 0)


def test_clauses_and_cache():
    assert J.query_clauses("Find the parser. Explain the cache.") == ("Find the parser. Explain the cache.", "the parser", "the cache")
    assert J.query_clauses("x = 1") == ("x = 1",)
    assert J.query_clauses("explain the cache and how it evicts") == ("explain the cache and how it evicts", "the cache", "how it evicts")
    assert J.query_clauses("find a;b")[1:] == ("a", "b") and J.query_clauses("Foo. and how bar")[1:] == ("Foo", "and how bar")
    assert J.query_clauses("cats and dogs but no birds") == ("cats and dogs but no birds",)
    assert J.query_clauses("Please locate: both x. show mean values. trace, y?")[1:] == ("x", "mean values", "y")
    now = [0.0]
    c = J.Answers(seconds=10, most=2, clock=lambda: now[0])
    for k in "abc":
        c.put(k, k)
    assert c.get("a") is None and c.get("c") == "c"
    now[0] = 11.0
    assert c.get("c") is None


def test_contract():
    assert X.checked_output({"schema_version": 1, "text": "x"})["units"] == [{"text": "x"}]
    for bad in ({}, {"schema_version": 1}, {"schema_version": 1, "text": "x", "units": []}, {"schema_version": 1, "units": [{"text": 1}]}, {"schema_version": 1, "units": [{"text": "x", "locator": {"kind": "odd"}}]}):
        with pytest.raises(X.OutputError):
            X.checked_output(bad)
    rule = X.Rule("*", "r", entry_point="json:loads")
    assert not X.approved(set(), [rule]) and X.approved({X.policy_digest([rule])}, [rule])
    with pytest.raises(X.OutputError):
        X.Rule("*", "r")
    assert X.run_rule(X.Rule("*", "r", command=("false",)), "p", b"")[0] == "skipped"
    assert X.run_rule(X.Rule("*", "r", command=("printf", '{"schema_version":1,"text":"hi"}')), "p", b"")[1]["units"] == [{"text": "hi"}]


def test_stamps():
    s = M.stamp("vault_docs")
    assert M.compatible(s) == "ok" and M.compatible(None) == "unstamped" and M.compatible({**s, "version": 9}) == "newer" and M.compatible({**s, "width": 3}) == "width"
    assert M.conformance(s, s, 1024) == "conforming" and M.conformance(s, s, 3) == "nonconforming" and M.conformance(None, s, 1) == "unverifiable"
    assert M.epoch(a=1) != M.epoch(a=2)


def test_headroom():
    assert X.headroom(1, 2 << 30) and not X.headroom(1, 1 << 30)


def test_queries_without_words():
    from plinth.operators.judge import query_clauses

    for blank in ("", " ", "\n\t"):
        assert query_clauses(blank) == (blank,)

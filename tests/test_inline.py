"""Inline Markdown: every construct, references, nesting, hard cases that must not take long, and the table function."""

import time

import pytest

from notespark.sources import inline
from notespark.sources import markdown as M

DEFINITIONS = {"r": "http://x.y", "foo bar": "u"}
CASES = [
    ("*a*", "*a*"),
    ("**a**", "**a**"),
    ("***a***", "***a***"),
    ("_a_ and __b__", "*a* and **b**"),
    ("a_b_c", "a_b_c"),
    ("*a **b** c*", "*a **b** c*"),
    ("**a *b***", "**a *b***"),
    ("*a", "*a"),
    ("a * b *", "a * b *"),
    ("~~x~~ ~y~", "~~x~~ ~~y~~"),
    ("~~~x~~~", "~~~x~~~"),
    ("[a][r]", "[a](http://x.y)"),
    ("[r][]", "[r](http://x.y)"),
    ("[r]", "[r](http://x.y)"),
    ("[Foo\n  bar]", "[Foo\n  bar](u)"),
    ("[a][none]", "[a][none]"),
    ('[*a* `c`](u "t")', '[*a* `c`](u)'),
    ("![al*t*](i.png)", "![alt](i.png)"),
    ("[![x](y)](z)", "[![x](y)](z)"),
    ("[a [b](c) d](e)", "[a [b](c) d](e)"),
    ("`a*b*`", "`a*b*`"),
    ("`` a`b ``", "`a`b`"),
    ("a  \nb", "a\nb"),
    ("a\\\nb", "a\nb"),
    ("a \nb", "a\nb"),
    ("\\*a\\*", "*a*"),
    ("&amp; &#65; &nope;", "& A &nope;"),
    ("<b>x</b>", "x"),
    ("<http://a.b>", "[http://a.b](http://a.b)"),
    ("see https://a.b/c_d. ok", "see [https://a.b/c_d](https://a.b/c_d). ok"),
    ("www.x.org)", "[www.x.org](http://www.x.org))"),
    ("m@x.org", "[m@x.org](mailto:m@x.org)"),
    ("[[Simple]] [[T|A]]", "[[Simple]] [[T|A]]"),
    ("*foo [bar*](u)", "*foo [bar*](u)"),
    ("**foo*bar**", "**foo*bar**"),
    ("foo***bar***", "foo***bar***"),
    ("*foo**bar**baz*", "*foo**bar**baz*"),
    ("a ` b", "a ` b"),
    ("2 < 3 & 4", "2 < 3 & 4"),
    ("[x](<a b>)", "[x](a b)"),
    ("[x](a(b)c)", "[x](a(b)c)"),
    ("[link](u)(v)", "[link](u)(v)"),
    ("****", "****"),
    ("__a_b__", "**a_b**"),
    ("**a**b**c**", "**a**b**c**"),
]


@pytest.mark.parametrize("text,want", CASES)
def test_inline(text, want):
    assert inline.written(inline.parse(text, DEFINITIONS)) == want


def test_plain_text():
    assert inline.plain(inline.parse("a *b **c*** `d` [e *f*](u) ![g](h)<br>i")) == "a b c d e f gi"


def test_definitions_are_found_in_a_first_pass():
    p = M.parse_note("f/a.md", "T", "f/a.md", "See [x][Q], [Q].\n\n> [q]: ./o.md 'title'\n> text\n\n- a\n\n  [deep]: d.md\n- [deep]\n\n[q]: second.md\nAlso [x][ q ]\n===\n")
    said = [(n["type"], n["content"]) for n in p["nodes"][1:]]
    assert said == [("paragraph", "See [x](./o.md), [Q](./o.md)."), ("paragraph", "text"), ("bullet_group", ""), ("bullet", "a"), ("bullet", "[deep](d.md)"), ("topic", "Also [x](./o.md)")]
    assert [r[1:] for r in p["cross_refs"]] == [("f/o.md", "x"), ("f/o.md", "Q"), ("f/d.md", "deep"), ("f/o.md", "x")]


@pytest.mark.parametrize("text", ["*a " * 20_000, "[" * 20_000, "[a](b" * 10_000, " ".join("`" * k for k in range(1, 500)), "**a *b " * 10_000, "*a_ " * 10_000, "![[" * 8000 + "]" * 8000])
def test_odd_texts_take_no_quadratic_time(text):
    began = time.process_time()
    inline.parse(text)
    assert time.process_time() - began < 10


def test_table_function_agrees_with_the_parser(spark):
    texts = ["# H\n\ntext #t [[L]] *x [y][z]*\n\n[z]: u\n\n- a\n  - b", "", None, "> q\n\n| a | b |\n|---|---|\n| c | **d** |"]
    notes = spark.createDataFrame([(f"n{k}.md", "T", t) for k, t in enumerate(texts)] + [(None, "x", "y")], "note_id string, title string, markdown string")
    want = sorted(tuple(n[c] for c in M._NODE) for k, t in enumerate(texts) for n in M.parse_note(f"n{k}.md", "T", f"n{k}.md", t or "")["nodes"])
    M.register(spark)
    by_sql = spark.sql("SELECT n.* FROM {notes} p, LATERAL parse_note(p.note_id, p.title, p.markdown) n", notes=notes)
    for table in (by_sql, M.lateral_nodes(notes), M.nodes_of(M.parse(notes.filter("note_id IS NOT NULL")))):
        assert sorted(tuple(r[c] for c in M._NODE) for r in table.collect()) == want


@pytest.mark.parametrize("text,want", [("m\\@x.org", "m@x.org"), ("http\\://x.org www\\.x.org", "http://x.org www.x.org"), ("[a\\@b.c](u) ![a\\@b](i)", "[a@b.c](u) ![a@b](i)"), ("https://x.org/a\\_b\\.c", "[https://x.org/a_b.c](https://x.org/a_b.c)")])
def test_escaped_addresses_are_no_links(text, want):
    assert inline.written(inline.parse(text)) == want

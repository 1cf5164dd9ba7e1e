import hashlib

import pytest

from notespark import schemas
from notespark.sources import markdown as M


def parse(md, path="folder/note.md", title="T", limit=8000):
    return M.parse_note(path, title, path, md, limit)


def kinds(p):
    return [(n["type"], n["content"]) for n in p["nodes"]]


def test_headings_and_trails():
    n = parse("# A\n\n## B\n\nText under B.")["nodes"]
    assert [(x["type"], x["heading_trail"]) for x in n] == [("note", []), ("topic", []), ("subtopic", ["A"]), ("paragraph", ["A", "B"])]
    assert n[0]["content"] == "T" and n[0]["parent_id"] is None and [x["depth"] for x in n] == [0, 1, 2, 3]
    assert kinds(parse("Head\n====\n\ntext\nmore\n\nSub\n---\n"))[1:] == [("topic", "Head"), ("paragraph", "text\nmore"), ("subtopic", "Sub")]


def test_sentence_parts():
    n = parse("# H\n\nA. B. C.", limit=1)["nodes"]
    parts = [x for x in n if x["type"] == "sentence_part"]
    assert [p["sibling_order"] for p in parts] == [0, 1, 2] and "".join(p["content"] for p in parts) == "A. B. C."
    assert any(x["type"] == "paragraph" for x in n)


def test_lists():
    n = parse("# S\n\n- outer\n  - inner")["nodes"]
    by = {x["content"]: x for x in n}
    assert by["inner"]["parent_id"] == by["outer"]["id"] and [x["type"] for x in n].count("bullet_group") == 1
    assert [k for k, _ in kinds(parse("# S\n\n- a\n\n---\n\n- b"))].count("bullet_group") == 2
    assert [k for k, _ in kinds(parse("- a\n\n- b"))].count("bullet_group") == 1
    group = next(x for x in parse("- x")["nodes"] if x["type"] == "bullet_group")
    assert group["content"] == "" and group["content_hash"] == hashlib.sha256(b"").hexdigest()
    assert kinds(parse("1. one\n2. two\n   more"))[2:] == [("bullet", "one"), ("bullet", "two\nmore")]


def test_other_blocks():
    got = kinds(parse("> quoted\n> more\n\n```py\ncode #tag\n```\n\n---\n\n<div>x</div>\n\n| a | b |\n|---|---|\n| c | d |\n"))[1:]
    assert got == [("paragraph", "quoted\nmore"), ("paragraph", "```py\ncode #tag\n```"), ("paragraph", "---"), ("paragraph", "<div>x</div>"), ("paragraph", "abcd")]


def test_links_and_tags():
    assert parse("See [[Simple]] here.")["cross_refs"][0][1:] == ("Simple.md", None)
    assert parse("[[Target|Alias]]")["cross_refs"][0][1:] == ("Target.md", "Alias")
    assert parse("[l](./other.md)", "notes/foo/bar.md")["cross_refs"][0][1] == "notes/foo/other.md"
    assert parse("[x](https://example.com/a.md)")["cross_refs"] == []
    p = parse("---\ntags: [reading, inbox]\n---\nHello #idea world.\n\n`#no` ```\n#no\n```")
    assert [t[1:] for t in p["tags"]] == [("reading", "frontmatter"), ("inbox", "frontmatter"), ("idea", "inline")] and p["tags"][0][0] == p["nodes"][0]["id"]
    assert parse("---\ntags: a, '#b'\ntag: c\n---\nx")["tags"][0][1] == "a"
    assert parse("---\n: [bad\n---\nx")["tags"] == [] and M.split_frontmatter("---\n---\nx")[0] is None


def test_ids_are_stable():
    a, b = parse("# A\n\ntext"), parse("# A\n\nother")
    assert [x["id"] for x in a["nodes"]] == [x["id"] for x in b["nodes"]]


@pytest.mark.parametrize("md", ["", "   ", "\n\n", "#", "- ", "> ", "```", "[[", "# \n## \n", "a\n" * 2000])
def test_odd_notes(md):
    p = parse(md)
    ids = {n["id"] for n in p["nodes"]}
    assert len(ids) == len(p["nodes"]) and all(n["parent_id"] in ids for n in p["nodes"][1:])


def test_parse_as_table(spark):
    rows = spark.createDataFrame([("a.md", "A", "# H\n\ntext #t [[L]]"), ("b.md", None, None)], "note_id string, title string, markdown string")
    parsed = M.parse(rows)
    nodes = M.nodes_of(parsed)
    assert nodes.count() == 4 and M.tags_of(parsed).first().tag == "t" and M.cross_refs_of(parsed).first().target_path == "L.md"
    assert schemas.tree_faults(nodes).count() == 0 and schemas.checked_nodes(nodes).count() == 4

from datetime import date, datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notespark.functions import dates, globs
from notespark.functions import text as T
from notespark.sources import markdown as M

ANCHOR = date(2026, 4, 21)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "phrase,anchor,start,end",
    [
        ("what happened over the last 2 weeks", ANCHOR, "2026-04-08", "2026-04-21"),
        ("notes from March 16 onwards", ANCHOR, "2026-03-16", "2026-04-21"),
        ("events from April 20, 2026 occurred", ANCHOR, "2026-04-20", "2026-04-21"),
        ("from April 20, 2026", date(2026, 4, 15), "2026-04-15", "2026-04-15"),
        ("this month", ANCHOR, "2026-04-01", "2026-04-21"),
        ("last month", ANCHOR, "2026-03-01", "2026-03-31"),
        ("this week", ANCHOR, "2026-04-15", "2026-04-21"),
        ("today", ANCHOR, "2026-04-21", "2026-04-21"),
        ("yesterday", ANCHOR, "2026-04-20", "2026-04-20"),
        ("between March 1 and March 15", ANCHOR, "2026-03-01", "2026-03-15"),
        ("past 3 days", ANCHOR, "2026-04-19", "2026-04-21"),
        ("done on 2026-04-16", ANCHOR, "2026-04-16", "2026-04-16"),
        ("since 5 December onwards", ANCHOR, "2025-12-05", "2026-04-21"),
    ],
)
def test_date_ranges(phrase, anchor, start, end):
    r = dates.resolve_range(phrase, anchor)
    assert (r["start"], r["end"]) == (start, end)


def test_no_date_and_last_week():
    assert dates.resolve_range("no dates here", ANCHOR) is None
    assert dates.resolve_range("last week", ANCHOR) is None
    assert dates.strip_phrase("today", "today") == "today"
    assert dates.strip_phrase("what did I do Today please", "today") == "what did I do please"


def test_anchor():
    now = datetime(2026, 4, 21, 23, 30, tzinfo=timezone.utc)
    assert dates.anchor_date(now, 2) == date(2026, 4, 22)
    assert dates.anchor_date(now, 0, "America/New_York") == date(2026, 4, 21)
    assert dates.anchor_date(now, 2, "America/New_York") == date(2026, 4, 22)
    assert [dates.clamp_offset(x) for x in (99, -99, "x", None, 3.7)] == [14, -12, 0, 0, 3]


def test_daily_names(spark):
    rows = spark.createDataFrame([("2026-04-16",), ("planning",), ("2026-13-40",), ("2026-02-31",)], "n string")
    assert [r.x for r in rows.select(dates.daily_date(F.col("n")).alias("x")).collect()] == ["2026-04-16", None, None, None]
    assert value(spark, dates.note_date(F.lit("2025-01-02/x/2026-04-16.md"), F.lit(True))) == "2026-04-16"
    assert value(spark, dates.note_date(F.lit("2025-01-02/x/a.md"), F.lit(True))) == "2025-01-02"
    assert value(spark, dates.daily_date(F.lit("16.04.2026"), "DD.MM.YYYY")) == "2026-04-16"


def test_globs(spark):
    rows = spark.createDataFrame([("Daily/2026-04-16.md",), ("Daily/sub/2026-04-16.md",), ("daily/2026-04-16.md",), ("Daily\\x.md",), ("Other/notes.md",), ("Daily/a.txt",)], "p string")
    assert [r.x for r in rows.select(globs.path_matches(F.col("p"), ["Daily/**/*.md"]).alias("x")).collect()] == [True, True, True, True, False, False]
    with pytest.raises(ValueError):
        globs.globs_regex([])
    with pytest.raises(ValueError):
        globs.globs_regex([" "])
    assert globs.glob_like("a_b/**/*?.md") == "a\\_b/%/%_.md"
    folders = rows.select(globs.under_folder(F.col("p"), ["Daily/"]).alias("x"), globs.excluded(F.col("p"), ["", "Daily/sub"]).alias("y")).collect()
    assert [r.x for r in folders] == [True, True, False, False, False, True] and [r.y for r in folders] == [False, True, False, False, False, False]


def test_keyword_terms(spark):
    from notespark.operators.search import python_terms

    assert python_terms("pros and cons") == ["pros", "cons"]
    assert python_terms("AND OR NOT NEAR") == [] and python_terms("??!!...") == []
    many = " ".join(f"w{i}" for i in range(100))
    assert len(python_terms(many)) == 64 == len(value(spark, T.query_terms(F.lit(many))))
    assert value(spark, T.match_query(F.lit('say "hi" and go'))) == '"say" OR "hi" OR "go"'
    assert value(spark, T.match_query(F.lit("and"))) is None


def test_sentences(spark):
    text = "Dr. Smith went to Washington. He stayed.\n"
    assert value(spark, T.sentences(F.lit(text))) == ["Dr. Smith went to Washington. ", "He stayed."] == M.split_sentences(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.!? \n\tDrMe,gi", max_size=60))
def test_sentence_split_loses_nothing(text):
    import re

    assert "".join(M.split_sentences(text)) == re.sub(r"\n+\Z", "", text)


def test_text_helpers(spark):
    v = lambda c: value(spark, c)
    assert v(T.estimate_tokens(F.lit("a😀b"))) == 1 and v(T.js_length(F.lit("a😀b"))) == 4
    assert v(T.note_title(F.lit("x/y/Note.MD"))) == "Note" and v(T.note_title(F.lit(".md"))) == ".md"
    assert v(T.stem(F.lit("a/b.c.md"))) == "b.c" and v(T.directory(F.lit("a/b/c.md"))) == "a/b" and v(T.directory(F.lit("c.md"))) == ""
    assert v(T.truncate_tokens(F.lit("abcdefgh  ijkl"), 2)) == "abcdefg…"
    assert v(T.truncate_prefix(F.lit("x" * 50), 3)) == "x" * 9 + "..."
    assert v(T.normalize_tag(F.lit(" #a b "))) is None and v(T.normalize_tag(F.lit("#a"))) == "a"
    assert v(T.inline_tags(F.lit("Hello #idea `#code` ```\n#fence\n``` a#b #idea"))) == ["idea", "b"]
    assert v(T.chat_tags(F.lit("x #Job/App #job/app y#no (#z)"))) == ["job/app", "z"]
    refs = v(T.cross_refs(F.lit("See [[Simple]] and [[Target|Alias]] [l](./other.md) [x](https://e.com/a.md) ![i](img.png) [m](mailto:a@b)"), F.lit("notes/foo")))
    assert [(r.target_path, r.link_text) for r in refs] == [("Simple.md", None), ("Target.md", "Alias"), ("notes/foo/other.md", "l"), ("notes/foo/img.png", "i")]
    assert v(T.run_id(F.lit("r:a.md"))) == "r" and v(T.run_id(F.lit("a.md"))) == "recovery"
    assert v(T.strip_fence(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}' and v(T.strip_fence(F.lit(" x "))) == "x"
    assert v(T.agent_path_ok(F.lit("Drafts/a.md"), ["Drafts"])) and not v(T.agent_path_ok(F.lit("Drafts/../a.md"), ["Drafts"])) and not v(T.agent_path_ok(F.lit(" "), ["Drafts"]))
    assert T.canonical_json({"b": [1, {"z": 1, "a": None}], "a": "é"}) == '{"a":"é","b":[1,{"z":1}]}'
    assert v(T.write_like(F.lit("create_note"))) and not v(T.write_like(F.lit("search_notes")))
    assert T.stitch_limit(None, 1024) == 8192 and T.stitch_limit(None, 10) == 512 and T.stitch_limit(99) == 99
    with pytest.raises(ValueError):
        T.check_assembly(100, (0.33, 0.33, 0.33))


def test_snippet(spark):
    out = value(spark, T.snippet(F.lit("a/Note.md"), F.array(F.lit("A"), F.lit("B")), F.lit("m" * 5000), F.lit("s"), F.lit("")))
    lines = out.split("\n")
    assert lines[0] == '## Note: "Note" (a/Note.md)' and lines[1] == "### Section: A > B" and lines[4].endswith("…") and lines[7] == "s" and lines[10] == ""
    assert "(empty)" in value(spark, T.snippet(F.lit("n.md"), F.array().cast("array<string>"), F.lit(" "), F.lit(""), F.lit("")))


def test_far_ranges_and_day_first():
    anchor = date(2026, 4, 21)
    assert dates.resolve_range("last 1000000 days", anchor)["start"] == "0001-01-01" == dates.resolve_range("past 99999999999 weeks", anchor)["start"]
    assert dates.resolve_range("since 3 March", anchor) is None
    assert dates.resolve_range("since 3 March onwards", anchor)["start"] == "2026-03-03" == dates.resolve_range("since March 3", anchor)["start"]

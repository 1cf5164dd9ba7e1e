"""Store, search phases, indexing and chat end to end on small notes."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from notespark import ports
from notespark.engine import Engine
from notespark.operators import filters, indexing, ranking, search, tree
from notespark.plans import agent, chat
from notespark.sources import vault
from notespark.sources.store import Conflict, Store

NOTES = {
    "Work/x.md": "# Acme Corp\n\nAcme Corp mention one.\n\n## Deal\n\nAcme Corp and Acme Corp and Acme Corp again #deal/big\n",
    "Daily/2026-02-01.md": "---\ntags: [log]\n---\n# Day\n\nMet the vendor. See [[x]].\n\n- call Bob\n  - about Acme\n",
    "Research/y.md": "# Paper\n\nVectors and trees.\n",
}


def files(spark, notes):
    rows = spark.createDataFrame(list(notes.items()), "p string, t string")
    return vault.from_table(rows, F.col("p"), F.col("t"))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", daily_globs=["Daily/**/*.md"])
    assert {k: v for k, v in e.index(files(spark, NOTES)).items() if k != "run_id"} == {"enqueued": 3, "deleted": 0, "skipped": 0}
    return e


def paths(df):
    return sorted({r.note_path for r in df.collect()})


def test_index_tables(engine):
    s = engine.store
    n = s.read("nodes")
    meta = {r.note_id: r for r in s.read("note_meta").collect()}
    assert meta["Daily/2026-02-01.md"].note_date == "2026-02-01" and meta["Work/x.md"].note_date is None
    assert all(r.node_count == n.filter(F.col("note_id") == k).count() for k, r in meta.items())
    content = s.read("embeddings").filter("vector_type = 'content'")
    assert content.count() == n.filter("content <> ''").count()
    leaves = filters.non_leaves(n).filter(F.col("type").isin("note", "topic", "subtopic")).count()
    assert s.read("summaries").count() == leaves
    assert {r.tag for r in s.read("tags").collect()} == {"log", "deal/big"} and s.read("cross_refs").first().target_path == "x.md"
    assert engine.health()["db_ready"] and engine.status().first().pending == 0


def test_search_finds_and_filters(engine):
    top = engine.search(search.SearchRequest("Acme Corp deal", k=3)).orderBy("rank").collect()
    assert top[0].note_path == "Work/x.md" and "**Matched content:**" in top[0].snippet and [r.rank for r in top] == [1, 2, 3]
    assert paths(engine.search(search.SearchRequest("Acme", path_globs=["daily/**"]))) == ["Daily/2026-02-01.md"]
    assert paths(engine.search(search.SearchRequest("Acme", start="2026-02-01", end="2026-02-28"))) == ["Daily/2026-02-01.md"]
    assert paths(engine.search(search.SearchRequest("anything", tags=["DEAL"]))) == ["Work/x.md"]
    assert engine.search(search.SearchRequest("  ")).count() == 0
    assert engine.search(search.SearchRequest("Acme", path_globs=["Other/*.md"])).count() == 0
    assert engine.search(search.SearchRequest("Acme", hybrid=False)).count() > 0


def test_incremental_run(spark, engine):
    same = engine.index(files(spark, NOTES))
    assert (same["enqueued"], same["skipped"]) == (0, 3)
    before = {r.node_id: r.generated_at for r in engine.store.read("summaries").collect()}
    more = NOTES | {"Work/x.md": NOTES["Work/x.md"].replace("again", "twice"), "new.md": "# New\n\nbody"}
    del more["Research/y.md"]
    run = engine.index(files(spark, more), prune=True)
    assert (run["enqueued"], run["skipped"], run["deleted"]) == (2, 1, 1)
    s = engine.store
    ids = {r.id for r in s.read("nodes").collect()}
    assert not s.read("nodes").filter("note_id = 'Research/y.md'").count()
    assert {r.node_id for r in s.read("embeddings").collect()} <= ids and {r.node_id for r in s.read("summaries").collect()} <= ids
    changed = {r.node_id for r in s.read("summaries").collect() if before.get(r.node_id) != r.generated_at}
    titles = {r.content for r in s.read("nodes").collect() if r.id in changed}
    assert "Day" not in titles and {"Acme Corp", "Deal", "New"} <= titles
    assert engine.index(files(spark, more), force=True)["enqueued"] == 3


def test_chat(engine):
    ask = lambda text, **kw: list(engine.chat(chat.ChatRequest([{"role": "user", "content": text}], date(2026, 2, 1), **kw)))
    out = ask("what about Acme Corp?")
    assert out[-1]["outcome"] == "answered" and out[-1]["sources"] and not out[-1]["truncated"]
    out = ask("what did I do today", daily_globs=["Daily/*.md"])
    assert [s["note_path"] for s in out[-1]["sources"]] == ["Daily/2026-02-01.md"]
    assert ask("Acme", path_globs=["none/*.md"])[-1]["outcome"] == "insufficient_evidence"
    with pytest.raises(ValueError):
        ask(" ")
    engine.planner = ports.SearchOnlyPlanner()
    assert ask("Acme Corp")[-1]["outcome"] == "answered"
    engine.planner = type("Bad", (), {"plan": lambda self, r: "no json"})()
    assert ask("Acme Corp")[-1]["outcome"] == "needs_scope"
    engine.planner = None
    assert engine.chat_context(chat.ChatRequest([{"role": "user", "content": "Acme"}], date(2026, 2, 1))).count() > 0


def test_store_versions_and_dimension(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", 4)
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}/s", 8)
    row = lambda v, e: spark.createDataFrame([("n", "content", e, "m", 4, v)], "node_id string, vector_type string, embedding array<float>, model string, dimension int, content_hash string")
    s.upsert_embeddings(row("h1", [1.0] * 4))
    held = s.read("embeddings")
    s.upsert_embeddings(row("h2", [2.0] * 4))
    assert [r.content_hash for r in s.read("embeddings").collect()] == ["h2"] and [r.content_hash for r in held.collect()] == ["h1"]
    with pytest.raises(Exception, match="vector length"):
        s.upsert_embeddings(row("h3", [1.0] * 3))
    assert s.meta("embedding_dimension") == "4" and s.meta("x") is None


def test_store_commits_all_or_nothing(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", 4)
    meta = lambda *ids: spark.createDataFrame([(i, i, "h", None, 1, None) for i in ids], "note_id string, vault_path string, content_hash string, indexed_at timestamp, node_count long, note_date string")
    tag = spark.createDataFrame([("n1", "t", "inline")], "node_id string, tag string, source string")
    s.upsert_note_meta(meta(*(f"note{i}.md" for i in range(40))))
    with pytest.raises(RuntimeError, match="killed"), s.transaction():
        s.append("tags", tag)
        s.upsert_note_meta(meta("late.md"))
        assert s.read("tags").count() == 1 and s.read("note_meta").count() == 41
        raise RuntimeError("killed")
    other = Store(spark, f"file://{tmp_path}/s", 4)
    assert other.read("tags").count() == 0 and s.read("note_meta").count() == other.read("note_meta").count() == 40
    before = s._now()["tables"]["note_meta"]
    s.upsert_note_meta(meta("note7.md"))
    after = s._now()["tables"]["note_meta"]
    assert len(before) > 8 and sum(before[b] != after[b] for b in after) == 1 and s.read("note_meta").count() == 40
    quick = Store(spark, f"file://{tmp_path}/s", 4, retain_s=-1)
    quick.upsert_note_meta(meta("note7.md"))
    assert len(quick._names("_manifest")) <= 3 and quick.read("note_meta").count() == 40 and len(quick._names("note_meta")) == len({f.split("/")[1] for fs in quick._now()["tables"]["note_meta"].values() for f in fs})
    with pytest.raises(Conflict), s.transaction():
        s.upsert_note_meta(meta("mine.md"))
        other.upsert_note_meta(meta("theirs.md"))
    assert {r.note_id for r in s.read("note_meta").collect()} >= {"theirs.md"} and s.read("note_meta").filter("note_id = 'mine.md'").isEmpty()


def test_failing_notes_are_retried_then_dead(spark, tmp_path):
    class Fussy(ports.LeadSummarizer):
        def summarize(self, prompt):
            if "poison" in prompt:
                raise ValueError("cannot summarise this")
            return super().summarize(prompt)

    e = Engine(spark, f"file://{tmp_path}/q", summarizer=Fussy(), max_retries=1)
    run = e.index(files(spark, {"a.md": "# A\n\nCafé au lait", "bad.md": "# B\n\npoison"}))
    assert run["enqueued"] == 2 and run["dead"] == 1
    assert {r.note_id for r in e.store.read("note_meta").collect()} == {"a.md"} == {r.note_id for r in e.store.read("nodes").collect()}
    got = {r.payload[9:].split('"')[0]: (r.status, r.retry_count, r.error_message) for r in e.store.read("queue_items").collect()}
    assert got["a.md"] == ("completed", 0, None) and got["bad.md"][:2] == ("dead_letter", 2) and "cannot summarise" in got["bad.md"][2]
    steps = {r.note_path: (r.current_step, r.retry_count) for r in e.store.read("job_steps").collect()}
    assert steps == {"a.md": ("embedded", 0), "bad.md": ("dead_letter", 2)}
    s = e.status().first()
    assert (s.pending, s.processing, s.completed, s.dead_items, s.dead_jobs) == (0, 0, 1, 1, 1)
    assert sorted((r.note_path, r.status) for r in e.store.read("progress_events").filter("status <> 'processing'").collect()) == [("a.md", "completed"), ("bad.md", "dead_letter"), ("bad.md", "pending")]
    # the stored keyword index: accents don't matter, and the filter on terms reaches the scan
    c = e.corpus()
    hits = search.keyword_top(c.nodes, c.postings, c.stats, "cafe", 5)
    assert hits.count() == 1 and "In(term" in search.bm25(c.postings, c.stats, ["cafe"])._jdf.queryExecution().executedPlan().toString().replace("EqualTo(term", "In(term")
    have, made = ({(r.docs, round(r.avg_length, 6)) for r in x.collect()} for x in (c.stats, search.corpus_stats(e.store.read("nodes"))))
    assert have == made
    assert {tuple(r) for r in c.postings.collect()} == {(r.id, r.term, r.tf, r.length) for r in search.postings(e.store.read("nodes")).collect()}
    e.store.set_meta({"schema_version": "2"})  # an older store gets its index when it is opened
    with e.store.transaction():
        e.store._pending["tables"].pop("postings")
    assert Store(spark, f"file://{tmp_path}/q", 64).read("postings").count() == c.postings.count()


def test_vault_scan(spark, tmp_path):
    for p in ("a/x.md", "a/b/y.md", "c/z.md", "a/skip.txt", "root.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"text of {p} é")
    rows = vault.index_payload(vault.list_files(spark, f"file://{tmp_path}", ["a"], ["a/b"])).collect()
    assert [(r.path, r.content) for r in rows] == [("a/x.md", "text of a/x.md é")]
    assert sorted(r.path for r in vault.list_files(spark, f"file://{tmp_path}").collect()) == ["a/b/y.md", "a/x.md", "c/z.md", "root.md"]


# --- phases


def corpus(spark, n_summaries, d=4):
    nodes = [("r", None, "note", [], 0, "root")] + [(f"t{i}", "r", "topic", ["r"], i, f"topic {i}") for i in range(n_summaries)] + [(f"p{i}", f"t{i}", "paragraph", ["r", f"t{i}"], 0, f"para {i}") for i in range(n_summaries)]
    rows = [(i, "n", p, t, [], a, o, c, "n.md", None) for i, p, t, a, o, c in nodes]
    n = spark.createDataFrame(rows, "id string, note_id string, parent_id string, type string, heading_trail array<string>, ancestor_ids array<string>, sibling_order int, content string, vault_path string, note_date string")
    vec = [(f"t{i}", "summary", [float(i)] * d) for i in range(n_summaries)] + [(f"p{i}", "content", [float(n_summaries - i)] * d) for i in range(n_summaries)]
    e = spark.createDataFrame(vec, "node_id string, vector_type string, embedding array<float>")
    none = spark.createDataFrame([], "node_id string, summary string")
    tags = spark.createDataFrame([], "node_id string, tag string, source string")
    return search.Corpus(n, e, none, tags, search.postings(n), search.corpus_stats(n))


def test_coarse_cut_and_fallback(spark):
    zero = [0.0] * 4
    c = corpus(spark, 40)
    req = search.SearchRequest("none", k=50, coarse_k=25, hybrid=False)
    assert search.coarse(c, c.nodes, req, zero, 25).count() == 25
    got = {r.id for r in search.search_hits(c, req, zero, c.nodes).collect()}
    assert got == {f"p{i}" for i in range(25)}  # no fallback: the nearest paragraphs lie elsewhere
    few = corpus(spark, 7)
    got = search.search_hits(few, search.SearchRequest("none", k=50, coarse_k=32, hybrid=False), zero, few.nodes).collect()
    assert len(got) == 7 == len({r.id for r in got})
    assert [search.fallback_floor(k) for k in (1, 16, 32, 256)] == [4, 4, 8, 64] and [search.clamp_coarse(x) for x in (0, 300, "x", None)] == [1, 256, 32, 32]


def test_filter_comes_before_top_k(spark):
    c = corpus(spark, 40)
    kept = c.nodes.filter("id NOT IN ('t0', 't1', 't2', 'p39', 'p38', 'p37')")
    near = search.nearest(search.vector_rows(kept, c.embeddings, "content"), [0.0] * 4, 3)
    assert [r.id for r in near.orderBy("distance").collect()] == ["p36", "p35", "p34"]


def test_bm25_order_and_types(spark):
    n = spark.createDataFrame([("a", "topic", "Acme Corp note"), ("b", "topic", "Acme Corp Acme Corp Acme Corp"), ("c", "topic", "Acme Corp and Acme Corp"), ("d", "bullet", "Acme Acme"), ("e", "topic", "nothing")], "id string, type string, content string")
    posted, stats = search.postings(n), search.corpus_stats(n)
    ids = [r.id for r in search.keyword_top(n, posted, stats, "acme corp", 10, F.col("type").isin(search.COARSE_TYPES)).orderBy("bm25").collect()]
    assert ids[0] == "b" and set(ids) == {"a", "b", "c"}
    assert search.keyword_top(n, posted, stats, "AND OR", 10).count() == 0


def test_rrf(spark):
    ranks = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")
    order = lambda *ls: [r.id for r in ranking.fuse([ranks(x) for x in ls]).orderBy(F.desc("rrf_score"), "id").collect()]
    assert order("XYZ", "ZXY")[:2] == ["X", "Z"] and order("ba", "ab") == ["a", "b"] and order("ab", "ba") == order("ba", "ab")


def test_tree(spark):
    n = spark.createDataFrame([("r", None, "n", 0, "R"), ("a", "r", "n", 0, "A"), ("b", "r", "n", 1, "B"), ("l", "a", "n", 0, "L"), ("q", None, "m", 0, "Q")], "id string, parent_id string, note_id string, sibling_order int, content string")
    n = tree.with_ancestors(n)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r.ancestor_id for r in tree.ancestors(n, ids("l")).orderBy("pos").collect()] == ["r", "a"]
    assert [(r.id, r.sibling_id) for r in tree.siblings(n, ids("a", "q")).collect()] == [("a", "b")]
    assert {r.id for r in tree.descendants(n, ids("a")).collect()} == {"a", "l"}
    assert [r.id for r in tree.preorder(n.filter("note_id = 'n'")).orderBy("pre").collect()] == ["r", "a", "l", "b"]
    assert [r.id for r in tree.postorder(n.filter("note_id = 'n'")).orderBy("post").collect()] == ["l", "a", "b", "r"]
    assert {r.note_id: r.root_id for r in tree.note_roots(n).collect()} == {"n": "r", "m": "q"}
    n.createOrReplaceTempView("tree_nodes")
    assert {r.id for r in spark.sql(tree.subtree_sql("tree_nodes", ["r"])).collect()} == {"r", "a", "b", "l"}


def test_dirty_on_reshape(spark):
    base = [("r", None, "n", 0, "note", "h0"), ("t", "r", "n", 0, "topic", "h1"), ("p", "t", "n", 0, "paragraph", "h2")]
    cols = "id string, parent_id string, note_id string, sibling_order int, type string, content_hash string"
    prep = lambda rows: indexing.prepared(tree.with_ancestors(spark.createDataFrame(rows, cols)))
    ids = lambda new, old: sorted(r.id for r in indexing.dirty(prep(new), prep(old)).collect())
    assert ids(base, base) == [] and ids(base, base[:2]) == ["r", "t"] and ids(base, base[:2] + [("p", "t", "n", 0, "paragraph", "x")]) == ["p", "r", "t"]
    assert sorted(r.id for r in indexing.dirty(prep(base), prep([])).collect()) == ["r", "t"]


def test_filters(spark):
    n = spark.createDataFrame([("a", "Work/x.md", None), ("b", "Daily/2026-02-01.md", "2026-02-15"), ("c", "Daily/y.md", "2026-03-01")], "id string, vault_path string, note_date string")
    pick = lambda **kw: [r.id for r in n.filter(filters.request_filter(**kw)[0].column()).collect()]
    assert pick(start="2026-02-01", end="2026-02-28") == ["b"] and pick(end="2026-12-31") == ["b", "c"] and pick() == ["a", "b", "c"] and pick(start="") == ["a", "b", "c"]
    assert pick(path_globs=["daily/*.md"], start="2026-03-01") == ["c"]
    assert pick(path_globs=[" "]) == ["a", "b", "c"] and filters.request_filter(path_globs=[" "])[1] and pick(path_globs=[" "], strict=True) == []
    assert n.filter(filters.path_regex(F.col("vault_path"), "(")).count() == 0
    t = spark.createDataFrame([("a", "Foo", "inline"), ("b", "Foo/bar", "inline"), ("c", "food", "inline")], "node_id string, tag string, source string")
    assert sorted(r.id for r in filters.with_tag(n, t, ["foo"]).collect()) == ["a", "b"]


def test_budgets():
    big = "x" * 10_000
    out = chat.grounded_messages([{"role": "user", "content": "q"}], "ctx", big, big)
    assert [m["role"] for m in out] == ["system", "system", "system", "user"] and sum(chat.tokens(m["content"]) for m in out[:2]) <= chat.PROMPT_BUDGET
    assert chat.grounded_messages([{"role": "assistant", "content": "a"}], "ctx")[-1] == {"role": "user", "content": "ctx"}
    assert len(chat.grounded_messages([], " ")) == 1 and chat.messages_with_context([], "") == []
    assert chat.fit_prompts("", "", 10) == ("", "", 0.0) and chat.fit_prompts("a", "b", 0)[2] == 1.0 and chat.prompt_tokens("abcd") == chat.tokens(chat.POLICY) + 1
    p = chat.parse_input("what did I do? path:Daily/**/*.md last:14d #Job #job", date(2026, 4, 21))
    assert p == {"text": "what did I do? #Job #job", "path_globs": ["Daily/**/*.md"], "tags": ["job"], "start": "2026-04-07"}
    assert chat.parse_input("hello since:2026-04-01 before:2026-04-10", date(2026, 4, 21)) == {"text": "hello", "start": "2026-04-01", "end": "2026-04-10"}
    t = iter(range(100))
    assert list(chat.guarded(iter("abc"), 1, clock=lambda: next(t))) == ["a"]


def test_silent_model_is_cut():
    import time

    def silent():
        yield "a"
        time.sleep(30)
        yield "b"

    began = time.monotonic()
    assert list(chat.guarded(silent(), 0.4)) == ["a"] and time.monotonic() - began < 5
    stopped = []
    assert list(chat.guarded(silent(), 20, stop=lambda: stopped or stopped.append(1))) in (["a"], []) and time.monotonic() - began < 10

    def broken():
        yield "a"
        raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        list(chat.guarded(broken(), 5))


def test_chat_filters_reach_the_search():
    ask = chat.ChatRequest([{"role": "user", "content": "what about Acme path:Work/** since:2026-01-01 #deal"}], date(2026, 2, 1), tags=["x"])
    got = chat.to_search(chat.with_filters(ask))
    assert (got.query, got.path_globs, got.start, got.end, got.tags) == ("what about Acme #deal", ["Work/**"], "2026-01-01", None, ["x", "deal"])
    given = chat.with_filters(chat.ChatRequest(ask.messages, date(2026, 2, 1), start="2025-12-01"))
    assert (given.start, given.end) == ("2025-12-01", None)
    assert chat.parse_input("last:99999999999d", date(2026, 4, 21))["start"] == "0001-01-01"


def test_planner_is_told_what_is_known():
    seen = {}
    planner = type("P", (), {"plan": lambda self, r: seen.update(r) or "no json"})()
    ask = chat.ChatRequest([{"role": "assistant", "content": "hi"}, {"role": "user", "content": "go path:Work/**"}], date(2026, 2, 1), daily_globs=["Daily/*.md"])
    out = list(chat.run_chat(ask, None, None, planner, object()))
    assert out[-1]["outcome"] == "needs_scope" and seen["path_globs"] == ["Work/**"] and seen["daily_globs"] == ["Daily/*.md"] and len(seen["conversation"]) == 2
    assert agent.tools_summary([]) == {"calls": 0, "byType": {}, "failed": 0, "results": 0, "sources": 0, "overBudget": False}


def test_notes_are_written_as_files(spark, tmp_path):
    drafts = lambda *rows: spark.createDataFrame(rows, "path string, content string")
    refused = vault.write_notes(drafts(("Notes/a.md", "one"), ("Other/b.md", "no"), ("Notes/../x.md", "no")), f"file://{tmp_path}", ["Notes"])
    assert {r.path for r in refused.collect()} >= {"Other/b.md"}
    vault.write_notes(drafts(("Notes/a.md", "twö")), f"file://{tmp_path}", ["Notes"])
    assert (tmp_path / "Notes/a.md").read_text() == "twö" and not (tmp_path / "Other").exists()
    assert [r.path for r in vault.list_files(spark, f"file://{tmp_path}").collect()] == ["Notes/a.md"]


def test_plans():
    given = agent.PlanInput("p", "2026-04-30", daily_globs=["Daily/*.md"])
    call = {"type": "search_notes", "reason": "r", "query": "q"}
    read = {"type": "read_note", "reason": "r"}
    draft = {"task": " t ", "topic": "x", "entities": ["Zed", "alpha", "Zed", " beta "], "toolCalls": [read, call, call], "dateBoundedSynthesis": True}
    a, b = agent.normalize(given, draft), agent.normalize(given, draft | {"toolCalls": [call, read], "entities": ["beta", "Zed", "alpha"]})
    assert a == b and a["entities"] == ["alpha", "beta", "Zed"] and a["filters"]["dateRange"] == {"start": "2026-04-24", "end": "2026-04-30", "defaulted": True}
    assert a["filters"]["pathGlobs"] == ["Daily/*.md"] and [c["type"] for c in agent.in_execution_order(a["toolCalls"])] == ["search_notes", "read_note"]
    for bad in ({"task": "", "topic": "x"}, {"task": "t", "topic": "x", "toolCalls": [read]}, draft | {"grounding": {"allowExternalSources": True}}, draft | {"filters": {"dateRange": {"start": "2026-02-30"}}}):
        with pytest.raises(agent.PlanError):
            agent.normalize(given, bad)
    asked = agent.plan_or_ask(given, "```json\n[]\n```")
    assert asked["status"] == "needs_scope" and asked["missing"] == ["topic", "scope"] and agent.plan_summary(asked)["toolCallCount"] == 0
    assert agent.plan_summary(a)["taskLabel"].startswith("sha256:") and agent.planner_warning(a) is None
    assert agent.planner_warning(a | {"toolCalls": [call] * 9})["observed"] == 9
    over = agent.result(a, a["toolCalls"][0], "budget_exceeded", [{"node_id": "n", "note_path": "p"}], True)
    assert agent.over_budget(over) and agent.tool_warning(over["trace"])["configured"] in (12, 40)
    assert agent.token_usage({"promptTokens": 3.7, "completionTokens": 2}) == {"source": "reported", "promptTokens": 3, "completionTokens": 2, "totalTokens": 5}
    assert agent.token_usage(None) == {"source": "unavailable"} and agent.synthesis(a, [])["insufficient"]
    made = agent.synthesis(a, [agent.result(a, a["toolCalls"][0], "ok", [{"node_id": "n", "note_path": "p", "snippet": " s "}])])
    assert made["context"].endswith("[1] p#n\ns") and made["sources"] == [{"note_path": "p", "node_id": "n"}] and agent.source_summary(made["sources"])["hasNodeAnchors"]


def test_model_helpers():
    assert ports.suffix_deltas(["a", "ab", "ab", "abc"]) == ["a", "b", "c"]
    assert ports.sse_deltas(['data: {"choices":[{"delta":{"content":"x"}}]}', "data: [DONE]", "data: {bad", ": note"]) == ["x"]
    v = ports.HashEmbedder(8).embed(["a b", ""])
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and v[1] == [0.0] * 8

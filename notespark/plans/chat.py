"""Chat: filters in the prompt, grounded messages within a prompt budget, the run itself."""

from __future__ import annotations

import queue
import re
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import days_back, resolve_range, strip_phrase
from ..functions.text import chat_tags, stitch_limit
from ..operators.search import SearchRequest, stitch, stitched_context
from . import agent

PROMPT_BUDGET = 1200
CONTEXT_PREFIX = "Notes found for this question:\n"
POLICY = "Answer only from the vault context given in this conversation. Name the notes you used. If the context does not answer the question, say so; do not use other knowledge."
NO_EVIDENCE = "The indexed notes do not hold enough evidence to answer this."
TIMEOUT_S = 30.0


def tokens(text: str) -> int:
    return -(-(len(text.encode("utf-16-le")) // 2) // 4)


def cut(text: str, most: int) -> str:
    """The longest prefix that fits with three dots behind it."""
    if not text or tokens(text) <= most:
        return text
    return "..."[: max(1, most * 4)] if most <= 1 else text[: 4 * most - 3] + "..."


def fit_prompts(organization: str, persona: str, most: int) -> tuple[str, str, float]:
    """Both prompts within `most` tokens, the persona cut first, and the share that was cut."""
    org, chat = organization.strip(), persona.strip()
    before = tokens(org) + tokens(chat)
    if before == 0:
        return "", "", 0.0
    if most <= 0:
        return "", "", 1.0
    if before > most:
        if tokens(org) >= most:
            org, chat = cut(org, most), ""
        else:
            chat = cut(chat, most - tokens(org))
    after = tokens(org) + tokens(chat)
    return org, chat, (before - after) / before


def clamp_prompts(organization: str, persona: str) -> tuple[str, str]:
    """Never over the budget with the policy, whatever the rounding."""
    room = max(0, PROMPT_BUDGET - tokens(POLICY))
    while tokens(organization) + tokens(persona) > room and (organization or persona):
        if persona:
            n = tokens(persona) - 1
            persona = cut(persona, n) if n > 0 else ""
        else:
            n = tokens(organization) - 1
            organization = cut(organization, n) if n > 0 else ""
    return organization, persona


def prompt_tokens(organization: str = "", persona: str = "") -> int:
    return tokens(POLICY) + tokens(organization.strip()) + tokens(persona.strip())


def grounded_messages(messages: list[dict], context: str, organization: str = "", persona: str = "") -> list[dict]:
    """Policy, organization, persona, context, history; the context is a user turn if the last turn isn't one."""
    org, chat, _ = fit_prompts(organization, persona, max(0, PROMPT_BUDGET - tokens(POLICY)))
    org, chat = clamp_prompts(org, chat)
    head = [{"role": "system", "content": x} for x in (POLICY, org, chat) if x]
    context = context.strip()
    if not context:
        return head + messages
    if messages and messages[-1]["role"] == "user":
        return [*head, {"role": "system", "content": CONTEXT_PREFIX + context}, *messages]
    return [*head, *messages, {"role": "user", "content": context}]


def messages_with_context(messages: list[dict], context: str) -> list[dict]:
    return grounded_messages(messages, context) if context.strip() else list(messages)


def last_user_content(messages: list[dict]) -> str:
    text = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "").strip()
    if not text:
        raise ValueError("there is no user message")
    return text


def parse_input(raw: str, today: date) -> dict:
    """Text without its path:, since:, before: and last:Nd filters; tags stay in it."""
    s, out = raw.strip(), {}
    tags = list(dict.fromkeys(m.lower() for m in re.findall(r"(?:^|[\s(\[{])#([A-Za-z0-9][A-Za-z0-9/_-]*)\b", s)))
    paths = re.findall(r"\bpath:(\S+)", s)
    s = re.sub(r"\bpath:\S+", " ", s)
    start, end = (re.findall(rf"\b{w}:(\d{{4}}-\d{{2}}-\d{{2}})\b", s)[-1:] for w in ("since", "before"))
    s = re.sub(r"\b(?:since|before):\d{4}-\d{2}-\d{2}\b", " ", s)
    if days := re.findall(r"(?i)\blast:(\d+)d\b", s):
        start = [days_back(today, int(days[-1])).isoformat()]
        s = re.sub(r"(?i)\blast:\d+d\b", " ", s)
    out["text"] = re.sub(r"\s+", " ", s).strip()
    for k, v in (("path_globs", paths), ("tags", tags), ("start", start), ("end", end)):
        if v:
            out[k] = v[0] if k in ("start", "end") else v
    return out


def chat_filters(raw: Column, today: Column | None = None) -> dict[str, Column]:
    """parse_input for a column of prompts; last:Nd counts from today, and is text where that is not given."""
    s = F.trim(raw)
    last = lambda e: F.get(F.reverse(F.regexp_extract_all(s, F.lit(e), F.lit(1))), 0)
    bare = F.regexp_replace(F.regexp_replace(s, r"\bpath:\S+", " "), r"\b(?:since|before):\d{4}-\d{2}-\d{2}\b", " ")
    start = last(r"\bsince:(\d{4}-\d{2}-\d{2})\b")
    if today is not None:
        bare = F.regexp_replace(bare, r"(?i)\blast:\d+d\b", " ")
        most = F.datediff(today, F.lit("0001-01-01").cast("date"))
        days = F.least(F.coalesce(last(r"(?i)\blast:(\d+)d\b").try_cast("long"), most), most).cast("int")  # more than a long holds: as far as days go
        start = F.when(s.rlike(r"(?i)\blast:\d+d\b"), F.date_format(F.date_sub(today, days), "yyyy-MM-dd")).otherwise(start)
    return {
        "text": F.trim(F.regexp_replace(bare, r"\s+", " ")),
        "path_globs": F.regexp_extract_all(s, F.lit(r"\bpath:(\S+)"), F.lit(1)),
        "tags": chat_tags(s),
        "start": start,
        "end": last(r"\bbefore:(\d{4}-\d{2}-\d{2})\b"),
    }


POLL_S = 0.05


def guarded(stream: Iterator[str], timeout_s: float = TIMEOUT_S, stop=None, clock=time.monotonic) -> Iterator[str]:
    """The stream until its deadline or until stop() says so, then a quiet end, also while the model is silent: its pieces are read
    in a thread of their own. The return value tells whether it was cut. An error of the model is raised here."""
    end, pieces, left = clock() + timeout_s, queue.Queue(maxsize=64), threading.Event()

    def read() -> None:
        try:
            for piece in stream:
                while not left.is_set():
                    try:
                        pieces.put(("piece", piece), timeout=POLL_S)
                        break
                    except queue.Full:
                        continue
                if left.is_set():
                    return
            last = ("end", None)
        except BaseException as e:
            last = ("error", e)
        if not left.is_set():
            pieces.put(last)

    threading.Thread(target=read, daemon=True).start()
    try:
        while True:
            if clock() > end or (stop and stop()):
                return True
            try:
                kind, value = pieces.get(timeout=POLL_S)
            except queue.Empty:
                continue
            if kind == "error":
                raise value
            if kind == "end":
                return False
            yield value
    finally:
        left.set()


@dataclass
class ChatRequest:
    messages: list[dict]
    today: date
    tags: list[str] = field(default_factory=list)
    path_globs: list[str] = field(default_factory=list)
    start: str | None = None
    end: str | None = None
    daily_globs: list[str] = field(default_factory=list)
    organization: str = ""
    persona: str = ""
    k: int | None = None
    coarse_k: int | None = None
    stitch_tokens: int | None = None
    timeout_s: float = TIMEOUT_S


def with_filters(request: ChatRequest) -> ChatRequest:
    """The request with the filters that its last user message names, which leave the message; what the request itself gives wins
    for dates, and comes first for paths and tags."""
    at = max((i for i, m in enumerate(request.messages) if m["role"] == "user"), default=None)
    if at is None:
        return request
    found = parse_input(request.messages[at]["content"], request.today)
    text = found["text"] or request.messages[at]["content"]
    messages = [*request.messages[:at], {**request.messages[at], "content": text}, *request.messages[at + 1 :]]
    dated = request.start or request.end
    return replace(
        request, messages=messages, path_globs=list(dict.fromkeys([*request.path_globs, *found.get("path_globs", [])])), tags=list(dict.fromkeys([*request.tags, *found.get("tags", [])])),
        start=request.start if dated else found.get("start"), end=request.end if dated else found.get("end"),
    )


def to_search(request: ChatRequest) -> SearchRequest:
    """Dates named in the prompt count unless dates are given; daily-note paths then join in, and the phrase leaves the query."""
    prompt = last_user_content(request.messages)
    query, paths, start, end = prompt, list(request.path_globs), request.start, request.end
    if not (start or end) and (found := resolve_range(prompt, request.today)):
        start, end = found["start"], found["end"]
        paths = list(dict.fromkeys([*paths, *(g.strip() for g in request.daily_globs if g.strip())]))
        query = strip_phrase(prompt, found["phrase"])
    return SearchRequest(query, k=request.k, coarse_k=request.coarse_k, tags=request.tags, path_globs=paths, start=start, end=end)


def run_chat(request: ChatRequest, search, model, planner=None, tools=None, stop=None) -> Iterator[dict]:
    """Events: deltas, then sources and outcome. search(SearchRequest) gives ranked rows; planner and tools take the agent's way."""
    last_user_content(request.messages)
    request = with_filters(request)
    prompt = last_user_content(request.messages)
    if planner and tools:
        span = {"start": request.start, "end": request.end} if request.start or request.end else None
        given = agent.PlanInput(prompt, request.today.isoformat(), request.messages, request.path_globs or None, span, request.daily_globs, request.organization or None)
        plan = agent.plan_or_ask(given, planner.plan(agent.planner_request(given)))
        if plan["status"] == "needs_scope":
            yield {"delta": plan["reason"]}
            yield {"sources": [], "outcome": "needs_scope", "missing": plan["missing"]}
            return
        results = tools.run_all(plan)
        yield {"tools": agent.tools_summary(results)}
        made = agent.synthesis(plan, results)
        if any(agent.over_budget(r) for r in results) or made["insufficient"]:
            yield {"delta": NO_EVIDENCE}
            yield {"sources": [], "outcome": "insufficient_evidence"}
            return
        context, sources = made["context"], made["sources"]
    else:
        found = search(to_search(request)).cache()
        prefix = stitch(found, stitch_limit(request.stitch_tokens)).cache()
        try:
            context = stitched_context(prefix)
            rows = prefix.orderBy("rank").select("note_path", "node_id").collect()  # at most k
        finally:
            prefix.unpersist()
            found.unpersist()
        if not rows:  # no hit, or none that fits
            yield {"delta": NO_EVIDENCE}
            yield {"sources": [], "outcome": "insufficient_evidence"}
            return
        first = {}
        for r in rows:
            first.setdefault(r.note_path, r.node_id)
        sources = [{"note_path": p, "node_id": n} for p, n in first.items()]
    stream = guarded(model.stream(grounded_messages(request.messages, context, request.organization, request.persona)), request.timeout_s, stop)
    truncated = yield from _deltas(stream)
    yield {"sources": sources, "outcome": "answered", "truncated": bool(truncated)}


def _deltas(stream) -> Iterator[dict]:
    while True:
        try:
            yield {"delta": next(stream)}
        except StopIteration as e:
            return e.value

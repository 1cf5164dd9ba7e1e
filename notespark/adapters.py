"""Models behind HTTP, for the ports: embeddings and chat in the two common wire formats. Standard library only.

A `send(url, body, headers)` that yields the answer's lines may be given instead of the one over urllib; it must be picklable, as embedders
run in Spark's workers.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .ports import BATCH, check_length

Send = Callable[[str, dict, dict], Iterator[bytes]]


class ModelError(RuntimeError):
    """A model's answer that cannot be used."""


def over_http(url: str, body: dict, headers: dict) -> Iterator[bytes]:
    """The lines of the answer to a POST of JSON, as they come."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request) as answer:
            yield from answer
    except urllib.error.HTTPError as e:
        said = e.read().decode("utf-8", "replace")
        try:
            said = json.loads(said)["error"]["message"]
        except (ValueError, LookupError, TypeError):
            said = said[:200]
        raise ModelError(f"HTTP {e.code} from {url}: {said}") from None


def _whole(lines: Iterator[bytes], url: str) -> dict:
    text = b"".join(lines).decode("utf-8", "replace")
    try:
        found = json.loads(text)
    except ValueError:
        raise ModelError(f"no JSON from {url}: {text[:200]}") from None
    if not isinstance(found, dict):
        raise ModelError(f"no object from {url}: {text[:200]}")
    return found


def _headers(key: str | None) -> dict:
    return {"Authorization": f"Bearer {key}"} if key else {}


@dataclass
class IndexedEmbedder:
    """POST {base}/embeddings, at most `batch` texts each; answers carry an index by which vectors are put in order."""

    base: str
    model: str
    dimension: int
    key: str | None = None
    batch: int = BATCH
    send: Send = over_http

    def embed(self, texts: list[str]) -> list[list[float]]:
        out, url = [], f"{self.base.rstrip('/')}/embeddings"
        for at in range(0, len(texts), self.batch):
            part = texts[at : at + self.batch]
            data = _whole(self.send(url, {"model": self.model, "input": part}, _headers(self.key)), url).get("data")
            if not isinstance(data, list) or len(data) != len(part):
                raise ModelError(f"{len(part)} texts sent to {url}, {len(data) if isinstance(data, list) else 'no'} vectors returned")
            out += [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]
        for v in out:
            check_length(v, self.dimension)
        return out


@dataclass
class PlainEmbedder:
    """POST {base}/api/embed, all texts at once; `embeddings` in order, or for one text from older servers `embedding`."""

    base: str
    model: str
    dimension: int
    send: Send = over_http

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        url = f"{self.base.rstrip('/')}/api/embed"
        answer = _whole(self.send(url, {"model": self.model, "input": texts}, {}), url)
        out = answer.get("embeddings", [answer["embedding"]] if isinstance(answer.get("embedding"), list) else None)
        if not isinstance(out, list) or len(out) != len(texts):
            raise ModelError(f"{len(texts)} texts sent to {url}, {len(out) if isinstance(out, list) else 'no'} vectors returned")
        for v in out:
            check_length(v, self.dimension)
        return out


@dataclass
class StreamedChat:
    """POST {base}/chat/completions as server-sent events. After a stream, `usage` has its tokens (prompt, completion, total), or None where
    the server told none."""

    base: str
    model: str
    key: str | None = None
    send: Send = over_http
    usage: dict[str, int | None] | None = None

    def stream(self, messages: list[dict]) -> Iterator[str]:
        self.usage, other = None, []
        body = {"model": self.model, "messages": messages, "stream": True, "stream_options": {"include_usage": True}}
        events = 0
        for raw in self.send(f"{self.base.rstrip('/')}/chat/completions", body, _headers(self.key)):
            line = raw.decode("utf-8", "replace").strip()
            if not line.startswith("data:"):
                other.append(raw)
                continue
            events += 1
            if line[5:].strip() == "[DONE]":
                return
            try:
                event = json.loads(line[5:])
                self._count(event)
                said = event["choices"][0]["delta"].get("content") if event.get("choices") else None
            except (ValueError, LookupError, AttributeError, TypeError):
                continue  # a line that cannot be read is no text
            if said:
                yield said
        if not events:  # a server that does not stream answers with one object
            answer = _whole(iter(other), self.base)
            self._count(answer)
            choices = answer.get("choices") or [{}]
            if said := (choices[0].get("message") or {}).get("content"):
                yield said

    def _count(self, event: dict) -> None:
        told = event.get("usage")
        if told and self.usage is None:
            self.usage = {short: told.get(f"{short}_tokens") for short in ("prompt", "completion", "total")}

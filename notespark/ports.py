"""Ports for models, with deterministic local defaults; nothing here needs a network."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 2048


class Embedder(Protocol):
    model: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Summarizer(Protocol):
    model: str

    def summarize(self, prompt: str) -> str: ...


class ChatModel(Protocol):
    def stream(self, messages: list[dict]) -> Iterator[str]: ...


class Planner(Protocol):
    def plan(self, request: dict) -> str: ...


class HashEmbedder:
    """Signed feature hashing of words, unit length."""

    model = "hash"

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).astype(float).tolist()


class LeadSummarizer:
    """The first words of a prompt's sections, as a rubric."""

    model = "lead"

    def summarize(self, prompt: str) -> str:
        body = [x for x in prompt.split("\n") if x.strip() and not x.startswith("### ")]
        return "topics:\n" + "\n".join(f"- {x.strip()[:80]}" for x in body[:10]) + "\nentities:\ndates:\nactions:\ntags:"


class EchoChat:
    """Answers with the first lines of its context, in pieces."""

    def stream(self, messages: list[dict]) -> Iterator[str]:
        context = next((m["content"] for m in reversed(messages) if m["role"] == "system"), "")
        for line in context.split("\n")[:5]:
            yield line + "\n"


class SearchOnlyPlanner:
    """Plans one search over the prompt."""

    def plan(self, request: dict) -> str:
        prompt = request["user_prompt"]
        return json.dumps({"task": prompt, "topic": prompt, "toolCalls": [{"type": "search_notes", "reason": "find notes", "query": prompt}]})


def suffix_deltas(cumulative: list[str]) -> list[str]:
    """Deltas of a stream that repeats all it has said so far."""
    out, said = [], ""
    for text in cumulative:
        out.append(text[len(said) :] if text.startswith(said) else text)
        said = text
    return [x for x in out if x]


def sse_deltas(lines: list[str]) -> list[str]:
    """Text deltas of server-sent events; lines that can't be parsed are skipped."""
    out = []
    for line in lines:
        if not line.startswith("data:") or line[5:].strip() == "[DONE]":
            continue
        try:
            delta = json.loads(line[5:])["choices"][0]["delta"].get("content")
        except (ValueError, LookupError, AttributeError, TypeError):
            continue
        if delta:
            out.append(delta)
    return out


def embed_rows(rows: DataFrame, embedder: Embedder, text_col: str = "text") -> DataFrame:
    """rows plus `embedding`; batches of at most BATCH texts, counts and lengths checked."""
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(parts):
        for part in parts:
            for at in range(0, len(part), BATCH):
                piece = part.iloc[at : at + BATCH].copy()
                vectors = embedder.embed([t or "" for t in piece[text_col]])
                if len(vectors) != len(piece):
                    raise ValueError(f"{len(vectors)} vectors for {len(piece)} texts")
                for v in vectors:
                    check_length(v, embedder.dimension)
                piece["embedding"] = pd.Series(vectors, index=piece.index, dtype=object)
                yield piece

    return rows.mapInPandas(run, schema)


def check_length(vector: list[float], dimension: int) -> None:
    if len(vector) != dimension:
        raise ValueError(f"vector of {len(vector)} dimensions where {dimension} are stored")


def summarize_rows(rows: DataFrame, summarizer: Summarizer) -> DataFrame:
    """rows(node_id, prompt) to (node_id, summary); an empty answer is an error."""

    def run(parts):
        for part in parts:
            made = [summarizer.summarize(p) for p in part["prompt"]]
            if any(not m.strip() for m in made):
                raise ValueError("the model returned an empty summary")
            yield pd.DataFrame({"node_id": part["node_id"], "summary": made})

    return rows.select("node_id", "prompt").mapInPandas(run, "node_id string, summary string")


def checked_vector(c, dimension: int):
    """A vector column, failing at run time on another length."""
    return F.when(F.size(c) == dimension, c).otherwise(F.raise_error(F.concat(F.lit("vector length "), F.size(c))))

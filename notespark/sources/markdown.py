"""Notes to node trees: our own parser for a CommonMark subset with tables, run once a note by mapInPandas.

Blocks: headings (# and underlined), paragraphs, nested lists, fences, indented code, quotes, rules, HTML blocks, tables. Node ids are
hashes of note and position, so that a note parsed again gets the same ids.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import ABBREVIATIONS, DOT
from ..schemas import NODES
from ..session import ready
from . import inline

MAX_TOKENS = 8000
_ABBREVIATION = re.compile("|".join(re.escape(a) for a in ABBREVIATIONS), re.I)
_ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])(?:( +)(.*)|$)")
_RULE = re.compile(r"^ {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$")
_HEAD = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")


@dataclass
class Block:
    kind: str  # heading, paragraph, list, code, quote, rule, html, table
    text: str = ""
    depth: int = 0
    items: list[Item] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    cells: list[str] = field(default_factory=list)


@dataclass
class Item:
    blocks: list[Block]


def tokens(text: str) -> int:
    return -(-(len(text.encode("utf-16-le")) // 2) // 4)


def split_frontmatter(markdown: str) -> tuple[str | None, str]:
    """A leading block between --- lines, and the rest. An empty block is none."""
    text = markdown.lstrip()
    if not text.startswith("---\n"):
        return None, markdown
    end = text.find("\n---", 4)
    if end < 0:
        return None, markdown
    after = text.find("\n", end + 4)
    return text[4:end], "" if after < 0 else text[after + 1 :]


def parse_blocks(text: str) -> list[Block]:
    """Blocks with their inline text: a first pass finds blocks and link definitions, a second one reads the text in them."""
    definitions: dict[str, str] = {}
    blocks = _blocks(text.replace("\r\n", "\n").replace("\t", "    ").split("\n"), definitions)
    _read_inline(blocks, definitions)
    return blocks


def _read_inline(blocks: list[Block], definitions: dict[str, str]) -> None:
    for b in blocks:
        if b.kind in ("paragraph", "heading"):
            b.text = inline.written(inline.parse(b.text, definitions))
        elif b.kind == "table":
            b.text = "".join(inline.plain(inline.parse(c, definitions)) for c in b.cells)
        _read_inline(b.blocks, definitions)
        for item in b.items:
            _read_inline(item.blocks, definitions)


def _blocks(lines: list[str], definitions: dict[str, str]) -> list[Block]:
    out: list[Block] = []
    i, para = 0, []

    def flush() -> str:
        """The paragraph so far, which ends; what is left of it without link definitions becomes a block."""
        text = inline.take_definitions("\n".join(x.lstrip() for x in para), definitions).strip()
        para.clear()
        if text:
            out.append(Block("paragraph", text))
        return text

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            flush()
            i += 1
        elif para and re.match(r"^ {0,3}(=+|-+) *$", line):
            depth = 1 if "=" in line else 2
            if text := flush():
                out[-1] = Block("heading", re.sub(r"\s*\n\s*", " ", text), depth)
            else:
                para.append(line)
            i += 1
        elif m := _HEAD.match(line):
            flush()
            out.append(Block("heading", (m[2] or "").strip(), len(m[1])))
            i += 1
        elif _RULE.match(line):
            flush()
            out.append(Block("rule", "---"))
            i += 1
        elif m := _FENCE.match(line):
            flush()
            close = re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}} *$")
            body, i = [], i + 1
            while i < len(lines) and not close.match(lines[i]):
                body.append(re.sub(rf"^ {{0,{len(m[1])}}}", "", lines[i]))
                i += 1
            i += 1
            out.append(Block("code", f"```{m[3].strip()}\n" + "\n".join(body) + "\n```"))
        elif (m := _ITEM.match(line)) and not (para and (m[2][0].isdigit() and m[2][:-1] != "1" or not m[4])):
            flush()
            i = _list(lines, i, out, definitions)
        elif re.match(r"^ {0,3}>", line):
            flush()
            body = []
            while i < len(lines) and lines[i].strip() and (re.match(r"^ {0,3}>", lines[i]) or not _starts_block(lines[i])):
                body.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            out.append(Block("quote", blocks=_blocks(body, definitions)))
        elif not para and re.match(r"^ {0,3}<(?:[A-Za-z/!?])", line) and not re.match(r"^ {0,3}<(?:https?:|mailto:)", line):
            body = []
            while i < len(lines) and lines[i].strip():
                body.append(lines[i])
                i += 1
            out.append(Block("html", "\n".join(body)))
        elif not para and "|" in line and i + 1 < len(lines) and re.match(r"^ *\|?(?: *:?-+:? *\|)+ *(?::?-+:? *)?$", lines[i + 1]):
            cells = []
            while i < len(lines) and lines[i].strip() and "|" in lines[i]:
                if not re.match(r"^[ |:-]+$", lines[i]):
                    cells += [c.strip() for c in lines[i].strip().strip("|").split("|")]
                i += 1
            out.append(Block("table", cells=cells))
        elif not para and line.startswith("    "):
            body = []
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                body.append(lines[i][4:])
                i += 1
            out.append(Block("code", "```\n" + "\n".join(body).rstrip("\n") + "\n```"))
        else:
            para.append(line)
            i += 1
    flush()
    return out


def _starts_block(line: str) -> bool:
    return bool(_HEAD.match(line) or _RULE.match(line) or _FENCE.match(line) or _ITEM.match(line))


def _list(lines: list[str], i: int, out: list[Block], definitions: dict[str, str]) -> int:
    """One list: items of the same marker kind; blank lines inside don't end it."""
    kind = _ITEM.match(lines[i])[2][-1]
    block = Block("list")
    while i < len(lines) and (m := _ITEM.match(lines[i])) and m[2][-1] == kind and not _RULE.match(lines[i]):
        indent = len(m[1]) + len(m[2]) + (len(m[3]) if m[4] and len(m[3] or "") <= 4 else 1)
        body, i = [m[4] or ""], i + 1
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                k = i
                while k < len(lines) and not lines[k].strip():
                    k += 1
                if k < len(lines) and lines[k].startswith(" " * indent):
                    body += [""] * (k - i)
                    i = k
                    continue
                break
            if line.startswith(" " * indent):
                body.append(line[indent:])
            elif not _starts_block(line) and body[-1].strip():
                body.append(line.strip())
            else:
                break
            i += 1
        block.items.append(Item(_blocks(body, definitions)))
        k = i
        while k < len(lines) and not lines[k].strip():
            k += 1
        if k > i and k < len(lines) and (m := _ITEM.match(lines[k])) and m[2][-1] == kind and not _RULE.match(lines[k]):
            i = k
    out.append(block)
    return i


def split_sentences(text: str) -> list[str]:
    body = re.sub(r"\n+\Z", "", text)
    masked = _ABBREVIATION.sub(lambda m: m[0].replace(".", DOT), body)
    pieces = re.split(r"(?<=\x1f)", re.sub(r"([.!?]\s+)", "\\1\x1f", masked))
    return [p for p in (x.replace("\x1f", "").replace(DOT, ".") for x in pieces) if p]


def frontmatter_tags(frontmatter: str | None) -> list[str]:
    """`tags` (a list, or separated by commas), then `tag`; what can't be read gives none."""
    if not frontmatter:
        return []
    data = _simple_yaml(frontmatter)
    found: list[str] = []
    for key in ("tags", "tag"):
        value = data.get(key)
        found += value if isinstance(value, list) else str(value).split(",") if isinstance(value, str) else []
    clean = (re.sub("^#", "", str(t).strip()) for t in found)
    return list(dict.fromkeys(t for t in clean if t and not re.search(r"\s", t)))


def _simple_yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml:
        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError:
            return {}
        return data if isinstance(data, dict) else {}
    out: dict = {}
    key = None
    for line in text.split("\n"):
        if m := re.match(r"^(\w+):\s*(.*)$", line):
            key, value = m[1], m[2].strip()
            out[key] = [x.strip().strip("'\"") for x in value[1:-1].split(",")] if value.startswith("[") and value.endswith("]") else value.strip("'\"") if value else []
        elif (m := re.match(r"^\s*-\s+(.*)$", line)) and isinstance(out.get(key), list):
            out[key].append(m[1].strip().strip("'\""))
    return out


def inline_tags(text: str) -> list[str]:
    code = [m.span() for m in re.finditer(r"```.*?(?:```|\Z)", text, re.S)]
    code += [m.span() for m in re.finditer(r"`[^`\n]*`", text)]
    spans = merge_spans(code)
    hits = (m for m in re.finditer(r"#([a-zA-Z0-9_/-]+)", text) if not any(a <= m.start() < b for a, b in spans))
    return list(dict.fromkeys(m[1] for m in hits))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def links(content: str, note_dir: str) -> list[tuple[str, str | None]]:
    slashes = lambda p: re.sub("/{2,}", "/", p.replace("\\", "/"))
    out: list[tuple[str, str | None]] = []
    for m in re.finditer(r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]", content):
        t = slashes(m[1].strip())
        out.append((t if "." in t.split("/")[-1] else t + ".md", (m[2] or "").strip() or None))
    for m in re.finditer(r"(?<!\[)\[([^\]\[]*)\]\(([^)\s]*)\)", content):
        t = m[2].strip()
        if t and not re.match(r"(?i)#|https?://|mailto:", t):
            bare = re.sub(r"^\./", "", slashes(t))
            out.append((slashes(f"{note_dir}/{bare}" if note_dir else bare), m[1] or None))
    return out


class _Tree:
    def __init__(self, note_id: str, title: str, limit: int):
        self.note_id, self.limit, self.nodes = note_id, limit, []
        self.prefix = hashlib.sha256(note_id.encode()).hexdigest()[:4]  # of all ids of a note: the store keeps them in one bucket
        self.children: dict[str | None, int] = {}
        self.root = self.add(None, "note", [], title.strip())

    def add(self, parent: dict | None, kind: str, trail: list[str], content: str) -> dict:
        above = parent["id"] if parent else None
        order = self.children.get(above, 0)
        self.children[above] = order + 1
        node_id = self.prefix + hashlib.sha256(f"{self.note_id}\0{above or ''}\0{kind}\0{order}".encode()).hexdigest()[:28]
        node = {
            "id": node_id, "note_id": self.note_id, "parent_id": above, "type": kind, "heading_trail": list(trail), "depth": parent["depth"] + 1 if parent else 0, "sibling_order": order,
            "content": content, "content_hash": hashlib.sha256(content.encode()).hexdigest(), "ancestor_ids": [*parent["ancestor_ids"], above] if parent else [], "ordinal": len(self.nodes),
        }
        self.nodes.append(node)
        return node

    def paragraph(self, parent: dict, trail: list[str], text: str) -> None:
        text = re.sub(r"\n+\Z", "", text)
        if not text:
            return
        node = self.add(parent, "paragraph", trail, text)
        parts = split_sentences(text)
        if tokens(text) > self.limit and len(parts) >= 2:
            for p in parts:
                self.add(node, "sentence_part", trail, p)

    def item(self, parent: dict, trail: list[str], item: Item) -> None:
        nested = [b for b in item.blocks if b.kind == "list"]
        said = "\n\n".join(_flat(b) for b in item.blocks if b.kind != "list")
        bullet = self.add(parent, "bullet", trail, said)
        for inner in nested:
            for x in inner.items:
                self.item(bullet, trail, x)


def _flat(b: Block) -> str:
    return "\n\n".join(_flat(x) for x in b.blocks) if b.kind == "quote" else b.text


def parse_note(note_id: str, title: str, vault_path: str, markdown: str, limit: int = MAX_TOKENS) -> dict[str, list]:
    """nodes (document order), tags and cross references of one note."""
    frontmatter, body = split_frontmatter(markdown)
    tree = _Tree(note_id, title, limit)
    stack: list[tuple[int, dict, str]] = []

    def place(blocks: list[Block]) -> None:
        for b in blocks:
            parent = stack[-1][1] if stack else tree.root
            trail = [t for *_, t in stack]
            if b.kind == "heading":
                while stack and stack[-1][0] >= b.depth:
                    stack.pop()
                parent = stack[-1][1] if stack else tree.root
                node = tree.add(parent, "topic" if b.depth == 1 else "subtopic", [t for *_, t in stack], b.text)
                stack.append((b.depth, node, b.text))
            elif b.kind == "list":
                group = tree.add(parent, "bullet_group", trail, "")
                for item in b.items:
                    tree.item(group, trail, item)
            elif b.kind == "quote":
                place(b.blocks)
            else:
                tree.paragraph(parent, trail, b.text)

    place(parse_blocks(body))
    tags = [(tree.root["id"], t, "frontmatter") for t in frontmatter_tags(frontmatter)]
    refs = []
    folder = vault_path.rpartition("/")[0]
    for n in tree.nodes[1:]:
        if n["type"] == "sentence_part":
            continue
        tags += [(n["id"], t, "inline") for t in inline_tags(n["content"])]
        refs += [(n["id"], target, text) for target, text in links(n["content"], folder)]
    return {"nodes": tree.nodes, "tags": list(dict.fromkeys(tags)), "cross_refs": refs}


PARSED = (
    "note_id string, nodes array<struct<id string, note_id string, parent_id string, type string, heading_trail array<string>, depth int, sibling_order int, content string, content_hash string, ancestor_ids array<string>, ordinal int>>, "
    "tags array<struct<node_id string, tag string, source string>>, cross_refs array<struct<source_node_id string, target_path string, link_text string>>"
)


def parse(notes: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """notes(note_id, title, markdown) to one row a note with arrays of nodes, tags and links."""

    def run(parts):
        for part in parts:
            rows = []
            for note_id, title, markdown in zip(part["note_id"], part["title"], part["markdown"]):
                p = parse_note(note_id, title or "", note_id, markdown or "", limit)
                rows.append((note_id, p["nodes"], [dict(zip(("node_id", "tag", "source"), t)) for t in p["tags"]], [dict(zip(("source_node_id", "target_path", "link_text"), r)) for r in p["cross_refs"]]))
            yield pd.DataFrame(rows, columns=["note_id", "nodes", "tags", "cross_refs"])

    return notes.select("note_id", "title", "markdown").mapInPandas(run, PARSED)


class ParseNote:
    """The parser as a table function: note_id, title and markdown to the nodes of the note, in document order."""

    def eval(self, note_id: str, title: str, markdown: str):
        if note_id is not None:
            for n in parse_note(note_id, title or "", note_id, markdown or "")["nodes"]:
                yield tuple(n[c] for c in _NODE)


_NODE = ("id", "note_id", "parent_id", "type", "heading_trail", "depth", "sibling_order", "content", "content_hash", "ancestor_ids", "ordinal")
parse_note_table = udtf(ParseNote, returnType=NODES, useArrow=True)


def register(spark: SparkSession) -> None:
    """Makes the parser callable from SQL: `SELECT n.* FROM notes, LATERAL parse_note(note_id, title, markdown) n`."""
    ready(spark).udtf.register("parse_note", parse_note_table)


def lateral_nodes(notes: DataFrame) -> DataFrame:
    """notes(note_id, title, markdown) as nodes, by the table function."""
    called = parse_note_table(*[F.col(c).outer() for c in ("note_id", "title", "markdown")])
    return notes.select("note_id", "title", "markdown").lateralJoin(called.alias("n")).select("n.*")


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.selectExpr("inline(nodes)")


def tags_of(parsed: DataFrame) -> DataFrame:
    return parsed.selectExpr("inline(tags)")


def cross_refs_of(parsed: DataFrame) -> DataFrame:
    return parsed.selectExpr("inline(cross_refs)")

"""Inline Markdown: code spans, emphasis, strong, strike, links, images, autolinks, escapes, entities, breaks.

Text is cut into tokens once. Runs of * _ ~ go on a stack of delimiters, brackets on another one; a closing run looks back for the
nearest run that may open it, and what is matched is noted at the two tokens as marks, from which a tree is made in the end. Brackets
become links by what follows them, or by the definitions that a first pass over the blocks has found. Written as text again, the
tree has its markup in one form: `*` for emphasis, `**`, `~~`, `[text](url)`, `![alt](url)`; line breaks are line ends, HTML tags go.
A bare address is a link unless its `@`, its `:` or the dot of its `www.` is escaped.
"""

from __future__ import annotations

import html
import re
import string
import unicodedata
from dataclasses import dataclass, field

_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|<([\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_TAG = re.compile(r"<(?:/[A-Za-z][\w-]*\s*|[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|!--.*?--|\?.*?\?|![A-Za-z][^>]*)>", re.S)
_DEST = re.compile(r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]", re.S)
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<([^<>\n]*)>|(\S+))(?:[ \t]*\n?[ \t]+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)")
_BARE = re.compile(r"(?<![\w/@.+-])(?:(https?://|www\.)[^\s<]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)")
_PIECE = re.compile(r"[^\\`*_~\[\]!<&\n]+")


@dataclass
class Node:
    kind: str  # text, literal (text that is in no bare address), code, break, strong, emphasis, delete, link, image
    value: str = ""
    children: list[Node] = field(default_factory=list)


@dataclass
class _Token:
    node: Node | None = None
    text: str = ""  # of a delimiter or bracket that is literal
    closes: int = 0  # marks that end here
    opens: list[Node] = field(default_factory=list)  # marks that begin here, the innermost first


@dataclass
class _Run:
    token: _Token
    char: str
    n: int
    opens: bool
    closes: bool
    length: int


def normal_label(label: str) -> str:
    return re.sub(r"\s+", " ", label.strip()).casefold()


def take_definitions(paragraph: str, found: dict[str, str]) -> str:
    """The paragraph without the link definitions that it begins with; of two of one label the first counts."""
    while m := _DEFINITION.match(paragraph):
        label = normal_label(m[1])
        if not label:
            break
        found.setdefault(label, _plain_text(m[2] if m[2] is not None else m[3]))
        paragraph = paragraph[m.end() :]
    return paragraph


def _plain_text(s: str) -> str:
    """s without escapes and entities."""
    s = _ENTITY.sub(lambda m: html.unescape(m[0]), s)
    return re.sub(r"\\([" + re.escape(string.punctuation) + "])", r"\1", s)


def _punctuation(c: str) -> bool:
    return c in string.punctuation or unicodedata.category(c)[0] in "PS"


def _flanks(char: str, before: str, after: str) -> tuple[bool, bool]:
    """May a run of char between these two characters open, and close?"""
    space_before, space_after = before.isspace(), after.isspace()
    mark_before, mark_after = not space_before and _punctuation(before), not space_after and _punctuation(after)
    left = not space_after and (not mark_after or space_before or mark_before)
    right = not space_before and (not mark_before or space_after or mark_after)
    if char == "_":
        return left and (not right or mark_before), right and (not left or mark_after)
    return left, right


class _Scanner:
    def __init__(self, text: str, definitions: dict[str, str]):
        self.text, self.definitions = text, definitions
        self.tokens: list[_Token] = []
        self.runs: list[_Run] = []
        self.brackets: list[tuple[_Token, int, int, bool]] = []  # token, runs below it, where its text begins, image?
        self.ticks: dict[int, list[int]] = {}  # where runs of backticks of each length begin, the last first
        for m in re.finditer("`+", text):
            self.ticks.setdefault(len(m[0]), []).insert(0, m.start())

    def say(self, text: str) -> None:
        if self.tokens and self.tokens[-1].node and self.tokens[-1].node.kind == "text":
            self.tokens[-1].node.value += text
        else:
            self.tokens.append(_Token(Node("text", text)))

    def scan(self) -> list[Node]:
        i, text = 0, self.text
        while i < len(text):
            i = self.step(i, text[i])
        self.match(0)
        return self.tree()

    def step(self, i: int, c: str) -> int:
        text = self.text
        if m := _PIECE.match(text, i):
            piece = m[0]
            if m.end() < len(text) and text[m.end()] == "\n":
                bare = piece.rstrip(" ")
                self.say(bare)
                if len(piece) - len(bare) >= 2:
                    self.tokens.append(_Token(Node("break")))
                    return m.end() + 1
                return m.end()
            self.say(piece)
            return m.end()
        if c == "\\" and i + 1 < len(text) and text[i + 1] == "\n":
            self.tokens.append(_Token(Node("break")))
            return i + 2
        if c == "\\" and i + 1 < len(text) and text[i + 1] in string.punctuation:
            if text[i + 1] in "@:" or text.endswith("www", 0, i) and text[i + 1] == ".":
                self.tokens.append(_Token(Node("literal", text[i + 1])))
            else:
                self.say(text[i + 1])
            return i + 2
        if c == "&" and (m := _ENTITY.match(text, i)) and html.unescape(m[0]) != m[0]:
            self.say(html.unescape(m[0]))
            return m.end()
        if c == "<" and (m := _AUTO.match(text, i)):
            self.tokens.append(_Token(Node("link", m[1] or f"mailto:{m[2]}", [Node("text", m[1] or m[2])])))
            return m.end()
        if c == "<" and (m := _TAG.match(text, i)):
            return m.end()
        if c == "`":
            return self.code(i)
        if c in "*_~":
            return self.run(i, c)
        if c == "[" or text.startswith("![", i):
            image = c == "!"
            self.tokens.append(_Token(text="![" if image else "["))
            self.brackets.append((self.tokens[-1], len(self.runs), i + 1 + image, image))
            return i + 1 + image
        if c == "]":
            return self.close(i)
        self.say(c)
        return i + 1

    def code(self, i: int) -> int:
        n = len(re.match("`+", self.text[i:])[0])
        starts = self.ticks[n]
        while starts and starts[-1] <= i:
            starts.pop()
        if not starts:
            self.say("`" * n)
            return i + n
        body = self.text[i + n : starts[-1]].replace("\n", " ")
        if body.strip(" ") and body[0] == body[-1] == " ":
            body = body[1:-1]
        self.tokens.append(_Token(Node("code", body)))
        return starts[-1] + n

    def run(self, i: int, c: str) -> int:
        end = i
        while end < len(self.text) and self.text[end] == c:
            end += 1
        before, after = self.text[i - 1] if i else " ", self.text[end] if end < len(self.text) else " "
        opens, closes = _flanks(c, before, after)
        self.tokens.append(_Token(text=self.text[i:end]))
        if c != "~" or end - i <= 2:
            self.runs.append(_Run(self.tokens[-1], c, end - i, opens, closes, end - i))
        return end

    def close(self, i: int) -> int:
        if not self.brackets:
            self.say("]")
            return i + 1
        token, below, began, image = self.brackets.pop()
        url, end, inner = None, i + 1, self.text[began:i]
        if token.node is None and token.text:  # not switched off by a link inside
            if (m := _DEST.match(self.text, i + 1)) is not None:
                url, end = _plain_text(m[1] if m[1] is not None else m[2]), m.end()
            else:
                m = _LABEL.match(self.text, i + 1)
                label = m[1] if m and m[1].strip() else inner
                url = self.definitions.get(normal_label(label)) if label.strip() else None
                end = m.end() if m and url is not None else i + 1
        if url is None:
            self.tokens.append(_Token(text="]"))
            return i + 1
        self.match(below)
        token.text = ""
        token.opens.append(Node("image" if image else "link", url))
        self.tokens.append(_Token(closes=1))
        if not image:  # links hold no links
            for k, (outer, *rest) in enumerate(self.brackets):
                if not rest[2] and outer.text:
                    outer.node, outer.text = Node("text", outer.text), ""
        return end

    def match(self, below: int) -> None:
        """Matches the runs above `below` and takes them off."""
        runs, floor = self.runs, {}
        c = below
        while c < len(runs):
            closer = runs[c]
            if not closer.closes:
                c += 1
                continue
            key = (closer.char, closer.opens, closer.length % 3)
            lowest, o = floor.get(key, below), c - 1
            while o >= lowest and not self._fit(runs[o], closer):
                o -= 1
            if o < lowest:
                floor[key] = c
                c += 1
                continue
            opener = runs[o]
            n = opener.n if closer.char == "~" else 2 if min(opener.n, closer.n) >= 2 else 1
            opener.token.opens.append(Node("delete" if closer.char == "~" else "strong" if n == 2 else "emphasis"))
            closer.token.closes += 1
            for run in (opener, closer):
                run.n -= n
                run.token.text = run.char * run.n
            del runs[o + 1 : c]
            c = o + 1
            floor = {k: min(v, c) for k, v in floor.items()}
            if not opener.n:
                del runs[o]
                c -= 1
            if not closer.n:
                del runs[c]
        del runs[below:]

    @staticmethod
    def _fit(opener: _Run, closer: _Run) -> bool:
        if opener.char != closer.char or not opener.opens:
            return False
        if closer.char == "~":
            return opener.n == closer.n
        both = opener.closes or closer.opens
        return not (both and (opener.length + closer.length) % 3 == 0 and (opener.length % 3 or closer.length % 3))

    def tree(self) -> list[Node]:
        root = Node("root")
        stack = [root]
        for t in self.tokens:
            for _ in range(t.closes):
                stack.pop()
            if t.node:
                _append(stack[-1], t.node)
            if t.text:
                _append(stack[-1], Node("text", t.text))
            for mark in reversed(t.opens):
                stack[-1].children.append(mark)
                stack.append(mark)
        return _linked(root.children)


def _append(parent: Node, node: Node) -> None:
    last = parent.children[-1] if parent.children else None
    if node.kind == "text" and last is not None and last.kind == "text":
        last.value += node.value
    else:
        parent.children.append(Node(node.kind, node.value, node.children))


def _linked(nodes: list[Node]) -> list[Node]:
    """Bare addresses as links, but inside links."""
    out: list[Node] = []
    for node in nodes:
        if node.kind != "text":
            if node.kind not in ("link", "image"):
                node.children = _linked(node.children)
            out.append(node)
            continue
        at = 0
        for m in _BARE.finditer(node.value):
            said = m[0].rstrip("?!.,:*_~'\"")
            while said.endswith(")") and said.count(")") > said.count("("):
                said = said[:-1].rstrip("?!.,:*_~'\"")
            if m[1] and not re.match(r"(?:https?://|www\.)[\w-]+", said):
                continue
            url = said if m[1] and m[1] != "www." else f"http://{said}" if m[1] else f"mailto:{said}"
            if m.start() > at:
                out.append(Node("text", node.value[at : m.start()]))
            out.append(Node("link", url, [Node("text", said)]))
            at = m.start() + len(said)
        if at < len(node.value):
            out.append(Node("text", node.value[at:]))
    return out


def parse(text: str, definitions: dict[str, str] | None = None) -> list[Node]:
    return _Scanner(text, definitions or {}).scan()


def plain(nodes: list[Node]) -> str:
    """Text without markup; of images their description."""
    return "".join(n.value if n.kind in ("text", "literal", "code") else plain(n.children) for n in nodes)


#: What stands before and after the text of each kind.
_AROUND = {"code": "`", "strong": "**", "emphasis": "*", "delete": "~~"}


def written(nodes: list[Node]) -> str:
    """The tree as text with markup."""
    out = []
    for n in nodes:
        if n.kind in _AROUND:
            out.append(_AROUND[n.kind] + (n.value if n.kind == "code" else written(n.children)) + _AROUND[n.kind])
        elif n.kind == "link":
            out.append(f"[{written(n.children)}]({n.value})")
        elif n.kind == "image":
            out.append(f"![{plain(n.children)}]({n.value})")
        else:
            out.append("\n" if n.kind == "break" else n.value)
    return "".join(out)

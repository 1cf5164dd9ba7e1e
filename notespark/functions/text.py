"""Text functions as Columns: token estimates, titles, tags, links, sentences, hashes, snippets."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ABBREVIATIONS = ("e.g.", "i.e.", "Dr.", "Mr.", "Mrs.", "Ms.", "vs.", "etc.")
DOT = "\ue999"
OPERATORS = ("and", "or", "not", "near")
MAX_TERMS = 64
FRACTIONS = (0.6, 0.25, 0.15)
SNIPPET_TOKENS = 1024


def js_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(js_length(c) / 4).cast("long")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def note_title(path: Column) -> Column:
    base = base_name(path)
    bare = F.regexp_replace(base, r"(?i)\.md$", "")
    return F.when(bare == "", base).otherwise(bare)


def note_title_for(path: Column, override: Column | None = None) -> Column:
    return base_name(path) if override is None else F.coalesce(override, base_name(path))


def stem(path: Column) -> Column:
    """Base name up to its last dot; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normalize_slashes(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/")


def heading_trail(trail: Column) -> Column:
    return F.when(F.size(trail) > 0, F.array_join(trail, " > ")).otherwise(F.lit("(root)"))


def js_rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def truncate_tokens(c: Column, limit: int) -> Column:
    cut = F.concat(js_rtrim(F.substring(c, 1, max(0, 4 * limit - 1))), F.lit("…"))
    return F.when((c == "") | (estimate_tokens(c) <= limit), c).otherwise(cut)


def truncate_prefix(c: Column, limit: int) -> Column:
    """The longest prefix that fits with three dots behind it."""
    if limit <= 1:
        short = F.lit("..."[: max(1, limit * 4)])
    else:
        short = F.concat(F.substring(c, 1, 4 * limit - 3), F.lit("..."))
    return F.when(c == "", c).when(estimate_tokens(c) <= limit, c).otherwise(short)


def truncate_summary(c: Column, limit: int) -> Column:
    """Cut at the last line end, else the last blank, if that is past the middle."""
    head = F.substring(c, 1, limit)
    line = F.lit(limit) - F.locate("\n", F.reverse(head))
    word = F.lit(limit) - F.locate(" ", F.reverse(head))
    cut = F.when(head.contains("\n") & (line > limit * 0.5), line).when(head.contains(" ") & (word > limit * 0.5), word).otherwise(F.lit(limit))
    return F.when(F.length(c) <= limit, c).otherwise(js_rtrim(F.substr(c, F.lit(1), cut)))


def snippet(path: Column, trail: Column, matched: Column, siblings: Column, parents: Column, total: int = SNIPPET_TOKENS, fractions: tuple = FRACTIONS) -> Column:
    """The fixed eleven-line block with three tiers, each cut to its share of the budget."""
    check_assembly(total, fractions)
    a, b, c = (int(total * f) for f in fractions)
    shown = F.when(js_trim(matched) == "", F.lit("(empty)")).otherwise(matched)
    return F.concat_ws(
        "\n",
        F.concat(F.lit('## Note: "'), note_title(path), F.lit('" ('), path, F.lit(")")),
        F.concat(F.lit("### Section: "), heading_trail(trail)),
        F.lit(""), F.lit("**Matched content:**"), truncate_tokens(shown, a),
        F.lit(""), F.lit("**Sibling context:**"), truncate_tokens(F.coalesce(siblings, F.lit("")), b),
        F.lit(""), F.lit("**Parent summary:**"), truncate_tokens(F.coalesce(parents, F.lit("")), c),
    )


def check_assembly(total: int, fractions: tuple) -> None:
    if total <= 0 or any(f < 0 for f in fractions) or abs(sum(fractions) - 1) > 1e-6:
        raise ValueError("the budget must be positive and its fractions must sum to 1")


def stitch_limit(explicit: int | None, total: int = SNIPPET_TOKENS) -> int:
    return explicit if explicit else max(512, 8 * total)


# --- sentences


def mask_abbreviations(c: Column) -> Column:
    masked = c
    for a in ABBREVIATIONS:
        parts = a.split(".")[:-1]
        groups = "(?i)" + "".join(f"({p})\\." for p in parts)
        masked = F.regexp_replace(masked, groups, "".join(f"${i + 1}{DOT}" for i in range(len(parts))))
    return masked


def unmask(c: Column) -> Column:
    return F.replace(c, F.lit(DOT), F.lit("."))


def canonical_body(c: Column) -> Column:
    return F.regexp_replace(c, r"\n+\z", "")


def sentences(c: Column) -> Column:
    """Lossless: the pieces joined are the text without trailing line ends."""
    body = mask_abbreviations(canonical_body(c))
    cut = F.split(F.regexp_replace(body, r"(?U)([.!?]\s+)", "$1\u001f"), "\u001f")
    return F.transform(F.filter(cut, lambda s: s != ""), unmask)


# --- tags and links


def blank_code(c: Column) -> Column:
    """Fenced blocks, then inline code, replaced by blanks."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?(?:```|\z)", " "), r"`[^`\n]*`", " ")


def inline_tags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(blank_code(c), F.lit("#([a-zA-Z0-9_/-]+)"), F.lit(1)))


def chat_tags(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?:^|[\s(\[{])#([A-Za-z0-9][A-Za-z0-9/_-]*)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def normalize_tag(c: Column) -> Column:
    """Trimmed, without one leading #; null if nothing is left or white space is in it."""
    bare = F.regexp_replace(F.trim(c), "^#", "")
    return F.when((bare != "") & ~bare.rlike(r"\s"), bare)


def wikilink_target(c: Column) -> Column:
    return F.when(base_name(c).contains("."), c).otherwise(F.concat(c, F.lit(".md")))


def skip_link(c: Column) -> Column:
    return (c == "") | c.rlike(r"(?i)^(?:#|https?://|mailto:)")


def markdown_target(target: Column, note_dir: Column) -> Column:
    """Null for links that leave the vault; else relative to the note's folder."""
    bare = F.regexp_replace(normalize_slashes(F.trim(target)), r"^\./", "")
    full = F.when(note_dir == "", bare).otherwise(F.concat(note_dir, F.lit("/"), bare))
    return F.when(~skip_link(F.trim(target)), normalize_slashes(full))


def cross_refs(content: Column, note_dir: Column) -> Column:
    """Wikilinks, then markdown links: array of (target_path, link_text)."""
    wiki = F.regexp_extract_all(content, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    alias = F.regexp_extract_all(content, F.lit(r"\[\[[^\]|]+(?:\|([^\]]*))?\]\]"), F.lit(1))
    md_text = F.regexp_extract_all(content, F.lit(r"(?<!\[)\[([^\]\[]*)\]\([^)\s]*\)"), F.lit(1))
    md = F.regexp_extract_all(content, F.lit(r"(?<!\[)\[[^\]\[]*\]\(([^)\s]*)\)"), F.lit(1))
    wikis = F.zip_with(wiki, alias, lambda t, a: F.struct(wikilink_target(normalize_slashes(F.trim(t))).alias("target_path"), F.when(F.trim(a) != "", F.trim(a)).alias("link_text")))
    links = F.zip_with(md, md_text, lambda t, a: F.struct(markdown_target(t, note_dir).alias("target_path"), F.when(a != "", a).alias("link_text")))
    return F.filter(F.concat(wikis, links), lambda x: x["target_path"].isNotNull())


# --- keyword terms


def _folded() -> tuple[str, str]:
    """Lower-case letters that are an ASCII letter with marks, those letters, and the combining marks, which go."""
    pairs = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base, *marks = unicodedata.normalize("NFD", c.lower())
        if marks and base.isascii() and base.isalpha() and all(map(unicodedata.combining, marks)):
            pairs[c.lower()] = base
    return "".join(pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(pairs.values())


_FROM, _TO = _folded()
_FOLD = str.maketrans(_FROM[: len(_TO)], _TO, _FROM[len(_TO) :])


def fold_marks(c: Column) -> Column:
    """Lower case, without accents: `Café` and `cafe` are one term."""
    return F.translate(F.lower(c), _FROM, _TO)


def python_fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def terms(c: Column) -> Column:
    """All terms of a text, lower-cased and without accents, in order."""
    return F.filter(F.split(fold_marks(c), r"[^0-9a-z\u0080-\uffff]+"), lambda t: t != "")


def query_terms(c: Column, limit: int | None = MAX_TERMS) -> Column:
    """Distinct terms that are no operator words: the first `limit`, all if None."""
    words = F.array_distinct(F.filter(F.split(fold_marks(c), r"[^0-9a-z\u0080-\uffff]+"), lambda t: (t != "") & ~t.isin(*OPERATORS)))
    return words if limit is None else F.slice(words, 1, limit)


def escape_phrase(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit('""'))


def match_query(c: Column) -> Column:
    """Quoted terms joined by OR; null if there is none."""
    ts = query_terms(c)
    return F.when(F.size(ts) > 0, F.array_join(F.transform(ts, lambda t: F.concat(F.lit('"'), escape_phrase(t), F.lit('"'))), " OR "))


# --- labels, ids, JSON


def trace_label(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.concat(F.lit("sha256:"), F.sha2(F.trim(c), 256)))


def job_id(run: Column, path: Column) -> Column:
    return F.concat_ws(":", run, path)


def run_id(job: Column) -> Column:
    return F.when(F.instr(job, ":") > 1, F.substring_index(job, ":", 1)).otherwise(F.lit("recovery"))


def strip_fence(c: Column) -> Column:
    inner = F.regexp_extract(F.trim(c), r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(F.trim(c).rlike(r"(?is)^```(?:json)?\s*.*?\s*```$"), inner).otherwise(F.trim(c))


def write_like(tool: Column) -> Column:
    return tool.rlike(r"(?i)write|create|delete|update|append|modify|rename|move")


def agent_path_ok(path: Column, roots: list[str]) -> Column:
    clean = F.regexp_replace(normalize_slashes(F.trim(path)), "^/+", "")
    under = reduce(lambda a, b: a | b, [(clean == r.strip("/")) | clean.startswith(r.strip("/") + "/") for r in roots], F.lit(False))
    return (clean != "") & ~F.array_contains(F.split(clean, "/"), "..") & under


def stable_unique(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, F.trim), lambda v: v != "")))


def canonical_json(value) -> str:
    """Keys sorted, no blanks, keys without a value left out."""

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if x is not None}
        return [clean(x) for x in v] if isinstance(v, list | tuple) else v

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

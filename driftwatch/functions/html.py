"""Markup as columns: tokens, element spans, attributes, addresses.

A page stays one row. Tokens and elements are arrays in that row, so all page
work is map-only; one Arrow function walks the tags of each page. Nesting follows an element stack: an end tag closes back to
its nearest open match or is ignored, void tags never nest, other unclosed
elements stay open to the end.
"""

from __future__ import annotations

import json
from collections import Counter
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags dropped with their content, and tags without an end tag.
DROPPED_BLOCKS = ("script", "style", "noscript", "head", "svg", "comment")
DROPPED_TAGS = ("meta", "link", "path")
PAGES_AT_ONCE = 256  # pages whose tags are walked before the next ones are taken
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)

#: What numeric references from 128 to 159 mean in markup: the characters of that Windows code page.
_WINDOWS = {f"#{n}": bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
#: Named references that end in a semicolon. The unbreakable space counts as a space.
_NAMED = {name[:-1]: value for name, value in html5.items() if name.endswith(";")} | {"nbsp": " ", "#160": " "}
_REFERENCES = json.dumps(_NAMED | _WINDOWS)

#: A tag's end, past quoted values that may hold ``>``; every branch starts differently, so nothing is tried twice.
_TAG_REST = r"""(?:[^=>]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=\s*+[^\s"'>])*+(?:=\s*+)?+>"""
#: A tag; one with an unclosed quote, a declaration or a cut-off tag; text, in which ``<`` may stand alone.
TOKEN = rf"</?[a-zA-Z]{_TAG_REST}|<[a-zA-Z/!?][^>]*+>?+|(?:[^<]++|<+[^a-zA-Z/!?<])++|<"
MARKUP = r"^<[a-zA-Z/!?]"
TAG_NAME = r"^</?([a-zA-Z][a-zA-Z0-9]*)"
HIDDEN_STYLE = r"display\s*:\s*none|visibility\s*:\s*hidden"
HIDING = rf"""(?s)[\s"'/](?i:style)\s*=\s*(?:"[^"]*(?:{HIDDEN_STYLE})|'[^']*(?:{HIDDEN_STYLE})|[^\s"'>]*(?:{HIDDEN_STYLE}))|[\s"'/](?i:aria-hidden)\s*=\s*(?:"true"|'true'|true[\s>])"""

NODE = "struct<pos:int,end:int,depth:int,tag:string,parent:int,children:int>"
SPAN = "struct<pos:int,end:int,tag:string>"
WALKED = f"struct<nodes:array<{NODE}>,hidden:array<{SPAN}>,covered:array<boolean>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _referred(part: Column) -> Column:
    """The text after a ``&``, with the reference it starts with replaced; ``&`` comes back if there is none."""
    table = F.from_json(F.lit(_REFERENCES), "map<string,string>")

    def code(name: Column) -> Column:
        hexadecimal = F.conv(F.regexp_replace(name, "^#[xX]0*", "0"), 16, 10).try_cast("int")
        number = F.when(name.rlike("^#[xX]"), hexadecimal).otherwise(F.regexp_replace(name, "^#", "").try_cast("int"))
        return F.when(F.startswith(name, F.lit("#")), number)

    def letter(n: Column) -> Column:
        valid = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("�")

    def value(name: Column, n: Column) -> Column:
        key = F.when(n.isNull(), name).when(n.between(128, 160), F.concat(F.lit("#"), n.cast("string")))
        found = F.coalesce(table[key], F.when(n.isNotNull(), letter(n)))
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        return F.coalesce(F.concat(found, rest), F.concat(F.lit("&"), part))

    name = F.regexp_extract(part, r"^(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
    return let(name, lambda x: let(code(x), lambda n: value(x, n)))


def decode(col: Column) -> Column:
    """Text with character references decoded, named and numeric, each once; they must end in a semicolon."""

    def decoded(x: Column) -> Column:
        parts = F.split(x, "&")
        return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(_referred(p))), "")

    return let(col, lambda x: F.when(F.contains(x, F.lit("&")), decoded(x)).otherwise(x))


def strip_blocks(html: Column) -> Column:
    """Page without comments and the elements that hold no content."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    for tag in DROPPED_BLOCKS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    return F.regexp_replace(out, rf"(?is)</?(?:{'|'.join(DROPPED_TAGS)})\b(?:{_TAG_REST}|[^>]*>)", "")


def tokenize(html: Column) -> Column:
    """Tags and texts of a cleaned page in order."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def tag_name(token: Column) -> Column:
    """Lower-case tag name of a tag token, null for text."""
    name = F.lower(F.regexp_extract(token, TAG_NAME, 1))
    return F.when(F.startswith(token, F.lit("<")) & F.endswith(token, F.lit(">")) & (name != ""), name)


def is_text(token: Column) -> Column:
    """Whether a token is text, which may start with a ``<`` of its own."""
    return ~(F.startswith(token, F.lit("<")) & token.rlike(MARKUP))


def attribute(token: Column, name: str) -> Column:
    """Decoded value of an attribute, null if the tag does not have it."""
    before = r"""(?is)[\s"'/]"""
    pattern = rf"""{before}{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    bare = F.when(token.rlike(rf"{before}{name}(\s|/|>)"), "")

    def value(raw: Column) -> Column:
        return F.when(raw != "", decode(F.regexp_replace(raw, r"""^["']|["']$""", ""))).otherwise(bare)

    # Most tags are short and have no attributes at all.
    found = let(F.regexp_extract(token, pattern, 1), value)
    return F.when(token.rlike(rf"(?i){name}"), found)


def attributes(token: Column) -> Column:
    """All attributes of a tag as a map; a repeated one keeps its last value."""
    body = F.regexp_replace(token, r"^<[a-zA-Z][a-zA-Z0-9]*|/?>$", "")
    raw = F.regexp_extract_all(
        body, F.lit(r"""[a-zA-Z_:][-a-zA-Z0-9_:.]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""), F.lit(0)
    )
    pairs = F.transform(
        raw,
        lambda r: F.struct(
            F.lower(F.regexp_extract(r, r"^([^\s=]+)", 1)).alias("name"),
            decode(
                F.regexp_replace(F.regexp_replace(r, r"^[^\s=]+\s*=?\s*", ""), r"""^["']|["']$""", "")
            ).alias("value"),
        ),
    )
    # keep the last of equal names: drop an entry if a later one has its name
    names = F.transform(pairs, lambda p: p["name"])
    kept = F.filter(
        pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), p["name"])
    )
    return F.map_from_entries(kept)


def marks(tokens: Column) -> Column:
    """What the walk needs of each token: its kind and tag name, without texts and attributes."""

    def mark(token: Column) -> Column:
        name = tag_name(token)
        void = name.isin(*VOID_TAGS) | F.endswith(token, F.lit("/>"))
        kind = F.when(F.startswith(token, F.lit("</")), "/").when(void, "!").otherwise("<")
        return F.when(is_text(token), "").otherwise(F.coalesce(F.concat(kind, name), F.lit("?")))

    return F.transform(tokens, mark)


def _walk(marks: list[str], hiding: list[int]):
    """Nodes, hidden spans and covered tokens of one page, by one walk with a stack."""
    found, stack, open_tags = [], [], Counter()

    def close(down_to: int, end: int) -> None:
        while len(stack) > down_to:
            node = stack.pop()
            open_tags[node[3]] -= 1
            node[1] = end

    for i, mark in enumerate(marks):
        kind, tag = mark[:1], mark[1:] or None
        if kind == "/":
            if open_tags[tag]:
                close(next(j for j in range(len(stack) - 1, -1, -1) if stack[j][3] == tag), i)
        elif kind != "?":
            node = [i, i + 1 if kind == "!" else i, len(stack), tag, stack[-1][0] if stack else -1, 0]
            found.append(node)
            if kind == "<":
                stack.append(node)
                open_tags[tag] += 1
    close(0, len(marks))
    spans, covered = [], []
    if hiding:
        asked = set(hiding)
        spans = [(n[0], n[1], n[3]) for n in found if n[0] in asked and n[3]]
        edges = np.zeros(len(marks) + 2, np.int64)
        for first, last, _ in spans:
            edges[first] += 1
            edges[min(last, len(marks)) + 1] -= 1
        covered = (np.cumsum(edges)[: len(marks)] > 0).tolist()
        found = [n for n in found if not covered[n[0]]]
    children = Counter(n[4] for n in found)
    for node in found:
        node[5] = children[node[0]]
    return found, spans, covered


def page_nodes(marks: Column, hiding: Column) -> Column:
    """Visible nodes of a page with their span, depth, parent and number of children, in page order; its hidden spans;
    and whether each token is hidden (empty if none is). Time is linear in the page, whatever its length.

    ``pos`` is the token index of the node, ``end`` the index where its content ends, ``tag`` is null for text. Depth
    counts open ancestors. ``hiding`` lists the tokens whose elements are hidden. Null marks give null.
    """

    def listed(rows: list, names: tuple[str, ...]) -> pa.Array:
        flat = list(zip(*(x for row in rows for x in row)))
        kinds = [pa.string() if n == "tag" else pa.int32() for n in names]
        columns = [pa.array(c, k) for c, k in zip(flat or [[]] * len(names), kinds)]
        return pa.ListArray.from_arrays(offsets(rows), pa.StructArray.from_arrays(columns, names=list(names)))

    def offsets(rows: list) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())

    @F.arrow_udf(WALKED)
    def walk(marks: pa.Array, hiding: pa.Array) -> pa.Array:
        # a batch of Spark's has thousands of pages; as Python objects only a few at a time
        cuts = range(0, max(len(marks), 1), PAGES_AT_ONCE)
        return pa.concat_arrays([walked(marks.slice(k, PAGES_AT_ONCE), hiding.slice(k, PAGES_AT_ONCE)) for k in cuts])

    def walked(marks: pa.Array, hiding: pa.Array) -> pa.Array:
        pages = [_walk(m or [], h or []) for m, h in zip(marks.to_pylist(), hiding.to_pylist())]
        found, spans, covered = ([p[k] for p in pages] for k in range(3))
        flags = pa.ListArray.from_arrays(offsets(covered), pa.array([x for row in covered for x in row], pa.bool_()))
        columns = [listed(found, ("pos", "end", "depth", "tag", "parent", "children")), listed(spans, ("pos", "end", "tag")), flags]
        return pa.StructArray.from_arrays(columns, names=["nodes", "hidden", "covered"], mask=marks.is_null())

    # evaluated once where it stands: the optimizer would copy it into lambdas that read its result
    return walk.asNondeterministic()(marks, hiding)


def host(url: Column) -> Column:
    """Host and port of an absolute address, empty if there is none."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def resolve(base: Column, href: Column) -> Column:
    """An address relative to a base address as an absolute one."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    target = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.substring(href, F.length(target) + 1, F.length(href))
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), target)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, _plain_path(target), rest))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path, href))
        .otherwise(F.concat(root, _plain_path(joined), rest))
    )


def _plain_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    ends_folder = path.rlike(r"/\.{1,2}$")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    plain = F.concat(F.array_join(kept, "/"), F.when(ends_folder, "/").otherwise(""))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), plain).otherwise(path)

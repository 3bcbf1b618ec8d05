"""Page extraction: text blocks, outline, links, forms, main content, features.

``parse`` turns the markup of a page into arrays once; every other operator
reads these arrays. Nothing here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions import html as h
from driftwatch.functions.text import clean_text, strip_dynamic, word_count

# Tags whose text forms a block, and the shortest block.
BLOCK_TAGS = (
    "title", "h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "span", "article", "section", "main", "nav",
    "header", "footer", "aside", "blockquote",
)
MIN_BLOCK_CHARS = 10
MAX_DEPTH = 10
DETAILED_TAGS = ("a", "img", "form", "input", "button")
SIDE_TAGS = ("header", "footer", "nav", "aside")

# Where the main content is looked for, best first (kind, value).
MAIN_SELECTORS = (
    ("tag", "main"), ("role", "main"), ("id", "main"), ("class", "main"), ("id", "content"), ("class", "content"),
    ("class", "post-content"), ("tag", "article"), ("class", "article"), ("id", "article"),
)


def parse(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``tokens``, ``nodes``, ``elements``, ``texts`` and the ``hidden`` spans.

    ``texts`` holds the clean text per token, empty for tags and hidden parts;
    ``nodes`` and ``elements`` leave hidden parts out.
    """
    cleaned = pages.withColumn("_clean", h.strip_blocks(F.col(html)))
    tokens = cleaned.withColumns(
        {
            "tokens": h.tokenize(F.col("_clean")),
            "_may_hide": F.col("_clean").rlike(rf"(?i)aria-hidden|{h.HIDDEN_STYLE}"),
        }
    ).drop("_clean")

    places = F.filter(F.transform("tokens", lambda t, i: F.when(t.rlike(h.HIDING), i)), lambda i: i.isNotNull())
    hiding = F.when(F.col("_may_hide"), places).otherwise(F.array().cast("array<int>"))
    walked = tokens.withColumn("_walked", h.page_nodes(h.marks(F.col("tokens")), hiding)).drop("_may_hide")

    def shown(token: Column, i: Column) -> Column:
        visible = ~F.coalesce(F.get(F.col("_walked.covered"), i), F.lit(False))
        return F.when(h.is_text(token) & visible, clean_text(h.decode(token))).otherwise("")

    parsed = walked.withColumns({"nodes": F.col("_walked.nodes"), "texts": F.transform("tokens", shown), "hidden": F.col("_walked.hidden")})
    no_attributes = F.create_map().cast("map<string,string>")

    def element(n: Column) -> Column:
        token = F.get("tokens", n["pos"])
        fields = [n[f].alias(f) for f in ("pos", "end", "depth", "tag", "parent", "children")]
        attrs = F.when(token.rlike(r"\s"), h.attributes(token)).otherwise(no_attributes)
        return F.struct(*fields, attrs.alias("attrs"))

    elements = F.transform(F.filter("nodes", lambda n: n["tag"].isNotNull()), element)
    return parsed.withColumn("elements", elements).drop("_walked")


def span_text(node: Column, texts: Column) -> Column:
    """Clean text inside an element.

    Over many elements, ``texts`` must be bound outside their lambda (``h.let``): the optimizer copies the column's
    expression to where it is read, and all texts of the page would be cleaned again for each element.
    """
    inside = F.slice(texts, node["pos"] + 2, F.greatest(node["end"] - node["pos"] - 1, F.lit(0)))
    return F.array_join(F.filter(inside, lambda x: x != ""), " ")


def _attribute(element: Column, name: str) -> Column:
    return element["attrs"][name]


def _body() -> Column:
    return F.get(F.filter("elements", lambda n: n["tag"] == "body"), F.lit(0))


def page_tokens(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Visible tokens of every page in order, with their tag name."""

    def inside(s: Column, pos: Column) -> Column:
        # the end token belongs to the element only if it is its own end tag
        own_end = (pos == s["end"]) & (h.tag_name(F.get("tokens", s["end"])) == s["tag"])
        return ((s["pos"] <= pos) & (pos < s["end"])) | own_end

    listed = F.transform("tokens", lambda tok, i: F.struct(i.alias("pos"), tok.alias("token")))
    seen = F.when(
        F.size("hidden") > 0, F.filter(listed, lambda t: ~F.exists("hidden", lambda s: inside(s, t["pos"])))
    ).otherwise(listed)
    rows = parsed.select(key, F.explode_outer(seen).alias("_t")).filter(F.col("_t").isNotNull())
    return rows.select(key, "_t.pos", "_t.token", h.tag_name(F.col("_t.token")).alias("tag"))


def outline(parsed: DataFrame) -> DataFrame:
    """Adds ``dom_outline``: the elements from the body down to depth 10."""

    def inside(n: Column, body: Column) -> Column:
        top = F.coalesce(body["depth"], F.lit(0))
        within = body.isNull() | ((n["pos"] >= body["pos"]) & (n["pos"] <= body["end"]))
        return within & (n["depth"] >= top) & (n["depth"] - top <= MAX_DEPTH)

    def describe(n: Column, body: Column, texts: Column) -> Column:
        return F.struct(
            n["pos"].alias("pos"),
            n["tag"].alias("tag"),
            (n["depth"] - F.coalesce(body["depth"], F.lit(0))).alias("depth"),
            F.filter(F.split(F.coalesce(_attribute(n, "class"), F.lit("")), r"\s+"), lambda c: c != "").alias("classes"),
            _attribute(n, "id").alias("id"),
            F.length(span_text(n, texts)).alias("text_length"),
            n["children"].alias("child_count"),
            F.when(n["tag"].isin(*DETAILED_TAGS), n["attrs"]).alias("attributes"),
        )

    # Values used once per element are bound first, or they would be computed for each.
    described = h.let(
        F.col("texts"),
        lambda texts: h.let(
            _body(), lambda body: F.transform(F.filter("elements", lambda n: inside(n, body)), lambda n: describe(n, body, texts))
        ),
    )
    return parsed.withColumn("dom_outline", described)


def text_blocks(parsed: DataFrame) -> DataFrame:
    """Adds ``text_blocks``: distinct texts of block elements, in page order."""
    chosen = F.filter("nodes", lambda n: n["tag"].isin(*BLOCK_TAGS))
    found = h.let(F.col("texts"), lambda texts: F.transform(chosen, lambda n: span_text(n, texts)))
    return parsed.withColumn("text_blocks", F.array_distinct(F.filter(found, lambda x: F.length(x) >= MIN_BLOCK_CHARS)))


def links(parsed: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``links``: absolute address, text, title and whether it leaves the host."""

    def describe(n: Column, texts: Column) -> Column:
        target = h.resolve(F.col(url), F.trim(_attribute(n, "href")))
        there = h.host(target)
        return F.struct(
            target.alias("url"),
            span_text(n, texts).alias("text"),
            F.coalesce(_attribute(n, "title"), F.lit("")).alias("title"),
            ((there != "") & (there != h.host(F.col(url)))).alias("is_external"),
        )

    def usable(n: Column) -> Column:
        href = F.trim(F.coalesce(_attribute(n, "href"), F.lit("")))
        return (n["tag"] == "a") & (href != "") & ~F.startswith(href, F.lit("#"))

    found = h.let(F.col("texts"), lambda texts: F.transform(F.filter("elements", usable), lambda n: describe(n, texts)))
    return parsed.withColumn("links", found)


def images(parsed: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``images``: absolute address, alternative text, title, size."""

    def value(n: Column, name: str) -> Column:
        return F.coalesce(_attribute(n, name), F.lit("")).alias(name)

    def describe(n: Column) -> Column:
        target = h.resolve(F.col(url), F.trim(_attribute(n, "src"))).alias("url")
        return F.struct(target, *[value(n, a) for a in ("alt", "title", "width", "height")])

    def usable(n: Column) -> Column:
        return (n["tag"] == "img") & (F.trim(F.coalesce(_attribute(n, "src"), F.lit(""))) != "")

    return parsed.withColumn("images", F.transform(F.filter("elements", usable), describe))


def forms(parsed: DataFrame) -> DataFrame:
    """Adds ``forms``: action, method and the inputs inside each form."""

    def value(n: Column, name: str, default: str = "") -> Column:
        return F.coalesce(_attribute(n, name), F.lit(default))

    def field(n: Column) -> Column:
        return F.struct(
            value(n, "type", "text").alias("type"),
            *[value(n, a).alias(a) for a in ("name", "id", "placeholder")],
            _attribute(n, "required").isNotNull().alias("required"),
        )

    def describe(n: Column, elements: Column) -> Column:
        inputs = F.filter(
            elements,
            lambda m: m["tag"].isin("input", "textarea", "select") & (m["pos"] > n["pos"]) & (m["pos"] < n["end"]),
        )
        return F.struct(
            value(n, "action").alias("action"), F.lower(value(n, "method", "get")).alias("method"),
            F.transform(inputs, field).alias("inputs"),
        )

    def described(elements: Column) -> Column:
        return F.transform(F.filter(elements, lambda n: n["tag"] == "form"), lambda n: describe(n, elements))

    return parsed.withColumn("forms", h.let(F.col("elements"), described))


def main_content(parsed: DataFrame) -> DataFrame:
    """Adds ``main_content``: the best main element, else the body without its sides."""

    def hits(kind: str, value: str):
        def test(n: Column) -> Column:
            if kind == "tag":
                return n["tag"] == value
            found = F.coalesce(_attribute(n, kind), F.lit(""))
            if kind == "class":
                return F.array_contains(F.split(found, r"\s+"), value)
            return found == value

        return test

    # Few elements can be a main area at all; the selectors only look at those.
    plausible = F.filter(
        "elements",
        lambda n: n["tag"].isin("main", "article")
        | F.coalesce(*[_attribute(n, a) for a in ("role", "id", "class")]).isNotNull(),
    )
    parsed = parsed.withColumn("_plausible", plausible)
    best = F.coalesce(*[F.get(F.filter("_plausible", hits(k, v)), F.lit(0)) for k, v in MAIN_SELECTORS])

    def outside_sides(body: Column, sides: Column) -> Column:
        kept = F.filter(
            F.transform("texts", lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
            lambda t: (t["x"] != "")
            & (
                body.isNull()
                | (
                    (t["i"] > body["pos"])
                    & (t["i"] < body["end"])
                    & ~F.exists(sides, lambda s: (s["pos"] < t["i"]) & (t["i"] < s["end"]))
                )
            ),
        )
        return F.array_join(F.transform(kept, lambda t: t["x"]), " ")

    rest = h.let(
        _body(),
        lambda body: h.let(
            F.filter("elements", lambda n: n["tag"].isin(*SIDE_TAGS)), lambda sides: outside_sides(body, sides)
        ),
    )
    staged = parsed.withColumn("_best", best)
    return staged.withColumn(
        "main_content", F.when(F.col("_best").isNotNull(), span_text(F.col("_best"), F.col("texts"))).otherwise(rest)
    ).drop("_best", "_plausible")


def title_meta(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``title`` and ``meta_description`` (else the og description)."""
    title = clean_text(h.decode(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))
    metas = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def content_of(name: str, value: str) -> Column:
        tag = F.get(F.filter("_metas", lambda m: F.coalesce(h.attribute(m, name), F.lit("")) == value), F.lit(0))
        return F.nullif(h.attribute(tag, "content"), F.lit(""))

    staged = pages.withColumns({"title": title, "_metas": metas})
    found = F.coalesce(content_of("name", "description"), content_of("property", "og:description"))
    return staged.withColumn("meta_description", found).drop("_metas")


def counts(blocked: DataFrame) -> DataFrame:
    """Adds ``word_count`` and ``character_count`` over the text blocks."""

    def total(measure) -> Column:
        return F.aggregate("text_blocks", F.lit(0).cast("long"), lambda acc, x: acc + measure(x))

    return blocked.withColumns(
        {"word_count": total(word_count), "character_count": total(lambda x: F.length(x).cast("long"))}
    )


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """All page fields: title, description, blocks, outline, links, images, forms, main content."""
    parsed = parse(title_meta(pages, html), html)
    steps = (text_blocks, counts, outline, lambda d: links(d, url), lambda d: images(d, url), forms, main_content)
    return reduce(lambda df, step: step(df), steps, parsed)


def features(extracted: DataFrame) -> DataFrame:
    """The 13 numeric features of each page."""

    def per_word(count: Column) -> Column:
        return F.when(F.col("word_count") > 0, count / F.col("word_count")).otherwise(0.0)

    n_links, n_images = F.size("links"), F.size("images")
    return extracted.withColumns(
        {
            "text_block_count": F.size("text_blocks"),
            "link_count": n_links,
            "external_link_count": F.size(F.filter("links", lambda x: x["is_external"])),
            "image_count": n_images,
            "form_count": F.size("forms"),
            "dom_depth": F.coalesce(F.array_max(F.transform("dom_outline", lambda x: x["depth"])), F.lit(0)),
            "has_main_content": F.coalesce("main_content", F.lit("")) != "",
            "title_length": F.length(F.coalesce("title", F.lit(""))),
            "meta_description_length": F.length(F.coalesce("meta_description", F.lit(""))),
            "links_per_word": per_word(n_links),
            "images_per_word": per_word(n_images),
        }
    )


def structure_text(outlined: DataFrame) -> DataFrame:
    """Adds ``structure_text``: ``tag:depth[.classes][#id]`` per element."""

    def signature(e: Column) -> Column:
        classes = F.when(F.size(e["classes"]) > 0, F.concat(F.lit("."), F.array_join(F.array_sort(e["classes"]), ".")))
        identity = F.when(F.coalesce(e["id"], F.lit("")) != "", F.concat(F.lit("#"), e["id"]))
        return F.concat(e["tag"], F.lit(":"), e["depth"].cast("string"), F.coalesce(classes, F.lit("")), F.coalesce(identity, F.lit("")))

    return outlined.withColumn("structure_text", F.array_join(F.transform("dom_outline", signature), "|"))


def element_signatures(outlined: DataFrame) -> DataFrame:
    """Adds ``signatures``: ``tag:depth[.classes]`` per element, for outline comparison."""

    def signature(e: Column) -> Column:
        classes = F.when(F.size(e["classes"]) > 0, F.concat(F.lit("."), F.array_join(F.array_sort(e["classes"]), ".")))
        return F.concat(e["tag"], F.lit(":"), e["depth"].cast("string"), F.coalesce(classes, F.lit("")))

    return outlined.withColumn("signatures", F.transform("dom_outline", signature))


def simple_structure_text(outlined: DataFrame) -> DataFrame:
    """Adds ``structure_text``: ``tag:depth:number of classes`` per element."""
    parts = F.transform(
        "dom_outline", lambda e: F.concat_ws(":", e["tag"], e["depth"].cast("string"), F.size(e["classes"]).cast("string"))
    )
    return outlined.withColumn("structure_text", F.array_join(parts, "|"))


def blocks_fingerprint(blocked: DataFrame) -> DataFrame:
    """Adds an order-insensitive digest of the text blocks and its counts."""
    kept = F.array_sort(F.filter(F.transform("text_blocks", strip_dynamic), lambda x: x != ""))
    staged = blocked.withColumn("_kept", kept).withColumn("_joined", F.array_join("_kept", "\n"))
    return staged.withColumns(
        {
            "hash_value": F.sha2("_joined", 256),
            "content_length": F.length("_joined"),
            "block_count": F.size("_kept"),
            "original_count": F.size("text_blocks"),
        }
    ).drop("_kept", "_joined")


def content_parts(
    extracted: DataFrame, key: str, max_blocks: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """One row per page and content type that has text, ready for embedding.

    All text blocks are joined, or the first ``max_blocks``; the combined part holds the whole main content, or its
    first ``max_chars`` characters.
    """
    listed, main = F.col("text_blocks"), F.col("main_content")
    block = F.array_join(listed if max_blocks is None else F.slice(listed, 1, max_blocks), " ")
    full = F.concat_ws(
        " ",
        F.nullif("title", F.lit("")),
        F.nullif(main if max_chars is None else F.substring(main, 1, max_chars), F.lit("")),
        F.nullif("meta_description", F.lit("")),
    )
    parts = F.array(
        *[
            F.struct(F.lit(name).alias("content_type"), value.alias("text"))
            for name, value in (
                ("main_content", F.col("main_content")), ("title", F.col("title")), ("text_blocks", block),
                ("meta_description", F.col("meta_description")), ("combined", full),
            )
        ]
    )
    rows = extracted.select(key, F.explode_outer(parts).alias("_p"))
    return rows.select(key, "_p.content_type", "_p.text").filter(F.coalesce("text", F.lit("")) != "")

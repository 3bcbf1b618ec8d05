"""Queries over page markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.functions import html as h
from driftwatch.functions import similarity as sim
from driftwatch.operators import pages as pg
from driftwatch.operators import verdicts as vd
from driftwatch.operators.sliced import lag_over
from driftwatch.operators.vectors import stand_in_embedding
from driftwatch.plans import sqltext as q
from driftwatch.plans.metrics_queries import rounded
from driftwatch.plans.registry import query


#: The character references that the tables hold, for the checking SQL (``&amp;`` last).
MARKS = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&#233;", "é"), ("&eacute;", "é"),
    ("&#x2014;", "—"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"),
)
TAG_REST = """(?:[^=>]|=\\s*"[^"]*"|=\\s*''[^'']*''|=\\s*[^\\s"''>])*(?:=\\s*)?>"""
TOKEN = f"</?[a-zA-Z]{TAG_REST}|<[a-zA-Z/!?][^>]*>?|(?:[^<]|<+[^a-zA-Z/!?<])+|<"


def decode_sql(x: str) -> str:
    for mark, value in MARKS:
        x = f"replace({x}, {q.lit(mark)}, {q.lit(value)})"
    return x


def attr_sql(tok: str, name: str) -> str:
    before = """[\\s"''/]"""
    raw = f"""regexp_extract({tok}, '(?is){before}{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)"""
    value = decode_sql("regexp_replace(" + raw + """, '^["'']|["'']$', '', 'g')""")
    return f"""CASE WHEN {raw} <> '' THEN {value} WHEN regexp_matches({tok}, '(?is){before}{name}(\\s|/|>)') THEN '' END"""


def source_sql(html: str) -> str:
    out = f"regexp_replace({html}, '(?is)<!--.*?-->', '', 'g')"
    for tag in h.DROPPED_BLOCKS:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    return f"regexp_replace({out}, '(?is)</?(?:{'|'.join(h.DROPPED_TAGS)})\\b(?:{TAG_REST}|[^>]*>)', '', 'g')"


VOIDS = ", ".join(f"'{v}'" for v in h.VOID_TAGS)
OPEN_T = "STRUCT(pos BIGINT, tag VARCHAR)[]"
NODE_T = "STRUCT(pos BIGINT, fin BIGINT, depth BIGINT, tag VARCHAR, parent BIGINT)[]"
LAST = "(len(stack) - list_position(list_reverse(list_transform(stack, lambda s: s.tag)), t.tag) + 1)"


def closing(stack: str, start: str, end: str) -> str:
    return (
        f"list_transform(range({start}, len({stack}) + 1), lambda j: {{'pos': {stack}[j].pos, 'fin': CAST({end} AS BIGINT), 'depth': j - 1, "
        f"'tag': {stack}[j].tag, 'parent': CASE WHEN j > 1 THEN {stack}[j - 1].pos ELSE -1 END}})"
    )


IS_CLOSE = "t.kind = 'close' AND list_contains(list_transform(stack, lambda s: s.tag), t.tag)"
PAGE_SQL = f"""
, tl AS (SELECT page_id, url, html, regexp_extract_all({source_sql('html')}, '{TOKEN}', 0) AS l FROM pages_injected),
tk0 AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS tok FROM tl),
tk AS (SELECT *, CASE WHEN NOT regexp_matches(tok, '^<[a-zA-Z/!?]') THEN 'text' WHEN tag IS NULL THEN 'other' WHEN tok[1:2] = '</' THEN 'close' WHEN tag IN ({VOIDS}) OR suffix(tok, '/>') THEN 'void' ELSE 'open' END AS kind
  FROM (SELECT *, CASE WHEN tok[1] = '<' AND suffix(tok, '>') THEN nullif(lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)), '') END AS tag FROM tk0) z),
r AS (SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS {OPEN_T}) AS stack, CAST([] AS {NODE_T}) AS done FROM tl
  UNION ALL SELECT r.page_id, i + 1,
    CASE WHEN t.kind = 'open' THEN list_append(stack, {{'pos': t.pos, 'tag': t.tag}}) WHEN {IS_CLOSE} THEN stack[1:{LAST} - 1] ELSE stack END,
    CASE WHEN t.kind IN ('text', 'void') THEN [{{'pos': t.pos, 'fin': t.pos + CASE t.kind WHEN 'void' THEN 1 ELSE 0 END, 'depth': len(stack), 'tag': t.tag, 'parent': CASE WHEN len(stack) > 0 THEN stack[-1].pos ELSE -1 END}}]
      WHEN {IS_CLOSE} THEN {closing('stack', LAST, 't.pos')} ELSE CAST([] AS {NODE_T}) END
  FROM r JOIN tk t ON t.page_id = r.page_id AND t.pos = r.i),
rest AS (SELECT r.page_id, {closing('stack', '1', 'i')} AS done FROM r JOIN tl ON tl.page_id = r.page_id AND i = len(l)),
nd0 AS (SELECT page_id, n.pos AS pos, n.fin AS fin, n.depth AS depth, n.tag AS tag, n.parent AS parent FROM (SELECT page_id, unnest(done) AS n FROM (SELECT page_id, done FROM r UNION ALL SELECT page_id, done FROM rest) z) y),
nd1 AS (SELECT n.*, t.tok FROM nd0 n JOIN tk t ON t.page_id = n.page_id AND t.pos = n.pos),
hid AS (SELECT * FROM nd1 WHERE tag IS NOT NULL AND (coalesce({attr_sql('tok', 'style')}, '') SIMILAR TO '.*(display\\s*:\\s*none|visibility\\s*:\\s*hidden).*' OR {attr_sql('tok', 'aria-hidden')} = 'true')),
nd AS (SELECT * FROM nd1 n WHERE NOT EXISTS (SELECT 1 FROM hid WHERE hid.page_id = n.page_id AND hid.pos <= n.pos AND n.pos <= hid.fin)),
el AS (SELECT * FROM nd WHERE tag IS NOT NULL),
txt AS (SELECT page_id, pos, {q.clean(decode_sql('tok'))} AS x FROM nd WHERE tag IS NULL),
et AS (SELECT e.page_id, e.pos, e.fin, e.depth, e.tag, e.parent, e.tok, coalesce(string_agg(x, ' ' ORDER BY t.pos) FILTER (x <> ''), '') AS text
  FROM el e LEFT JOIN txt t ON t.page_id = e.page_id AND t.pos > e.pos AND t.pos < e.fin GROUP BY ALL),
body AS (SELECT page_id, min(pos) AS pos, min_by(fin, pos) AS fin, min_by(depth, pos) AS depth FROM el WHERE tag = 'body' GROUP BY 1),
ol AS (SELECT e.page_id, e.pos, e.tag, e.depth - b.depth AS depth, e.tok, e.text, list_filter(regexp_split_to_array(coalesce({attr_sql('e.tok', 'class')}, ''), '\\s+'), lambda c: c <> '') AS classes,
  {attr_sql('e.tok', 'id')} AS id, (SELECT count(*) FROM nd c WHERE c.page_id = e.page_id AND c.parent = e.pos) AS kids
  FROM et e JOIN body b ON b.page_id = e.page_id AND e.pos >= b.pos AND e.pos <= b.fin WHERE e.depth - b.depth <= 10),
bl AS (SELECT page_id, min(pos) AS pos, text FROM et WHERE tag IN ({", ".join(f"'{x}'" for x in pg.BLOCK_TAGS)}) AND length(text) >= 10 GROUP BY page_id, text),
lk AS (SELECT e.page_id, e.pos, e.text, {attr_sql('e.tok', 'href')} AS href, coalesce({attr_sql('e.tok', 'title')}, '') AS title, p.url FROM et e JOIN pages_injected p USING (page_id) WHERE tag = 'a'),
ln AS (SELECT *, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href ELSE href END AS target FROM lk WHERE trim(href) <> '' AND href NOT LIKE '#%')
"""


def parsed(t):
    return pg.parse(t.pages_injected)


@query("page_tokens", ("pages_injected",), PAGE_SQL + """
SELECT page_id, CAST(pos AS INT) AS pos, tok AS token, tag FROM tk t WHERE NOT EXISTS (SELECT 1 FROM hid WHERE hid.page_id = t.page_id AND
  ((hid.pos <= t.pos AND t.pos < hid.fin) OR (t.pos = hid.fin AND t.tag = hid.tag)))""", recursive=True)
def page_tokens(t):
    return pg.page_tokens(parsed(t))


def attr_list_sql(tok: str) -> str:
    names = ("href", "src", "alt", "width", "action", "method", "type", "name", "required", "title")
    parts = ", ".join(f"CASE WHEN {attr_sql(tok, n)} IS NOT NULL THEN '{n}=' || {attr_sql(tok, n)} END" for n in sorted(names))
    return f"concat_ws(';', {parts})"


@query("page_dom_outline", ("pages_injected",), PAGE_SQL + f"""
SELECT page_id, CAST(pos AS INT) AS pos, tag, CAST(depth AS INT) AS depth, array_to_string(classes, ' ') AS classes, id, CAST(length(text) AS INT) AS text_length, CAST(kids AS INT) AS child_count,
  CASE WHEN tag IN ('a', 'img', 'form', 'input', 'button') THEN {attr_list_sql('tok')} END AS attributes FROM ol""", recursive=True)
def page_dom_outline(t):
    rows = pg.outline(parsed(t)).select("page_id", F.explode_outer("dom_outline").alias("e")).filter("e IS NOT NULL")
    shown = F.array_join(
        F.array_sort(F.transform(F.map_entries("e.attributes"), lambda x: F.concat_ws("=", x["key"], x["value"]))), ";"
    )
    return rows.select(
        "page_id", "e.pos", "e.tag", "e.depth", F.array_join("e.classes", " ").alias("classes"), "e.id", "e.text_length",
        "e.child_count", F.when(F.col("e.attributes").isNotNull(), shown).alias("attributes"),
    )


@query("page_text_blocks", ("pages_injected",), PAGE_SQL + """
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INT) AS block_no, text FROM bl""", recursive=True)
def page_text_blocks(t):
    blocks = pg.text_blocks(parsed(t)).select("page_id", F.posexplode_outer("text_blocks").alias("block_no", "text"))
    return blocks.filter("text IS NOT NULL")


@query("page_links", ("pages_injected",), PAGE_SQL + """
SELECT page_id, target AS url, text, title, coalesce(regexp_extract(target, '^[a-z]+://([^/?#]*)', 1) NOT IN ('', regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), false) AS is_external FROM ln""", recursive=True)
def page_links(t):
    return pg.links(parsed(t)).select("page_id", F.explode_outer("links").alias("x")).filter("x IS NOT NULL").select("page_id", "x.*")


@query("page_images", ("pages_injected",), PAGE_SQL + f"""
SELECT e.page_id, regexp_extract(p.url, '^[a-z]+://[^/?#]*') || {attr_sql('tok', 'src')} AS url, {", ".join(f"coalesce({attr_sql('tok', a)}, '') AS {a}" for a in ('alt', 'title', 'width', 'height'))}
FROM el e JOIN pages_injected p USING (page_id) WHERE tag = 'img' AND {attr_sql('tok', 'src')} <> ''""", recursive=True)
def page_images(t):
    return pg.images(parsed(t)).select("page_id", F.explode_outer("images").alias("x")).filter("x IS NOT NULL").select("page_id", "x.*")


@query("page_forms", ("pages_injected",), PAGE_SQL + f"""
SELECT f.page_id, coalesce({attr_sql('f.tok', 'action')}, '') AS action, lower(coalesce({attr_sql('f.tok', 'method')}, 'get')) AS method,
  string_agg(concat_ws('/', coalesce({attr_sql('i.tok', 'type')}, 'text'), coalesce({attr_sql('i.tok', 'name')}, ''), coalesce({attr_sql('i.tok', 'id')}, ''), coalesce({attr_sql('i.tok', 'placeholder')}, ''),
    CASE WHEN {attr_sql('i.tok', 'required')} IS NULL THEN 'false' ELSE 'true' END), ';' ORDER BY i.pos) AS inputs
FROM el f LEFT JOIN el i ON i.page_id = f.page_id AND i.pos > f.pos AND i.pos < f.fin AND i.tag IN ('input', 'textarea', 'select') WHERE f.tag = 'form' GROUP BY f.page_id, f.pos, f.tok""", recursive=True)
def page_forms(t):
    rows = pg.forms(parsed(t)).select("page_id", F.explode_outer("forms").alias("x")).filter("x IS NOT NULL")
    shown = F.transform("x.inputs", lambda i: F.concat_ws("/", i["type"], i["name"], i["id"], i["placeholder"], i["required"].cast("string")))
    return rows.select("page_id", "x.action", "x.method", F.array_join(shown, ";").alias("inputs"))


MAIN_SQL = f"""
, mc AS (SELECT p.page_id, coalesce((SELECT arg_min(text, CASE tag WHEN 'main' THEN 0 ELSE 7 END * 1000000 + pos) FROM et e WHERE e.page_id = p.page_id AND tag IN ('main', 'article')),
  (SELECT string_agg(x, ' ' ORDER BY t.pos) FROM txt t JOIN body b ON b.page_id = t.page_id AND t.pos > b.pos AND t.pos < b.fin WHERE t.page_id = p.page_id AND x <> ''
     AND NOT EXISTS (SELECT 1 FROM el s WHERE s.page_id = t.page_id AND s.tag IN ('header', 'footer', 'nav', 'aside') AND s.pos < t.pos AND t.pos < s.fin)), '') AS main_content FROM pages_injected p)
"""


@query("page_main_content", ("pages_injected",), PAGE_SQL + MAIN_SQL + "SELECT * FROM mc", recursive=True)
def page_main_content(t):
    return pg.main_content(parsed(t)).select("page_id", "main_content")


META = """replace(html, '<title>', CASE page_id % 3 WHEN 0 THEN concat('<meta name="description" content="about ', CAST(page_id AS STRING), '"><title>')
  WHEN 1 THEN concat('<meta property="og:description" content=''og &amp; ', CAST(page_id AS STRING), '''><title>') ELSE '<title>' END)"""


@query("page_title_meta", ("pages_injected",), f"""
, p AS (SELECT page_id, {META} AS html FROM pages_injected)
SELECT page_id, {q.clean(decode_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))} AS title,
  CASE page_id % 3 WHEN 0 THEN 'about ' || page_id WHEN 1 THEN 'og & ' || page_id END AS meta_description FROM p
""")
def page_title_meta(t):
    return pg.title_meta(t.pages_injected.select("page_id", F.expr(META).alias("html"))).drop("html")


@query("page_counts", ("pages_injected",), PAGE_SQL + """
SELECT page_id, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS word_count, CAST(sum(length(text)) AS BIGINT) AS character_count FROM bl GROUP BY 1""", recursive=True)
def page_counts(t):
    return pg.counts(pg.text_blocks(parsed(t))).select("page_id", "word_count", "character_count")


@query("page_features", ("pages_injected",), PAGE_SQL + MAIN_SQL + f"""
, w AS (SELECT page_id, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS wc, CAST(sum(length(text)) AS BIGINT) AS cc, count(*) AS bc FROM bl GROUP BY 1),
lc AS (SELECT page_id, count(*) AS n, count(*) FILTER (target LIKE 'https://ext.%') AS ext FROM ln GROUP BY 1),
k AS (SELECT page_id, count(*) FILTER (tag = 'img') AS im, count(*) FILTER (tag = 'form') AS fm FROM el GROUP BY 1), d AS (SELECT page_id, max(depth) AS depth FROM ol GROUP BY 1)
SELECT p.page_id, coalesce(wc, 0) AS word_count, coalesce(cc, 0) AS character_count, CAST(coalesce(bc, 0) AS INT) AS text_block_count, CAST(coalesce(n, 0) AS INT) AS link_count, CAST(coalesce(ext, 0) AS INT) AS external_link_count,
  CAST(coalesce(im, 0) AS INT) AS image_count, CAST(coalesce(fm, 0) AS INT) AS form_count, CAST(coalesce(depth, 0) AS INT) AS dom_depth, main_content <> '' AS has_main_content,
  CAST(length({q.clean(decode_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))}) AS INT) AS title_length, 0 AS meta_description_length,
  round(CASE WHEN wc > 0 THEN coalesce(n, 0) / wc ELSE 0 END, 6) AS links_per_word, round(CASE WHEN wc > 0 THEN coalesce(im, 0) / wc ELSE 0 END, 6) AS images_per_word
FROM pages_injected p LEFT JOIN w USING (page_id) LEFT JOIN lc USING (page_id) LEFT JOIN k USING (page_id) LEFT JOIN d USING (page_id) LEFT JOIN mc USING (page_id)""", recursive=True)
def page_features(t):
    out = pg.features(pg.extract(t.pages_injected))
    return rounded(
        out.select(
            "page_id", "word_count", "character_count", "text_block_count", "link_count", "external_link_count", "image_count",
            "form_count", "dom_depth", "has_main_content", "title_length", "meta_description_length", "links_per_word", "images_per_word",
        ),
        "links_per_word", "images_per_word",
    )


_SIG = "tag || ':' || depth || CASE WHEN len(classes) > 0 THEN '.' || array_to_string(list_sort(classes), '.') ELSE '' END || CASE WHEN coalesce(id, '') <> '' THEN '#' || id ELSE '' END"


@query("hash_structure", ("pages_injected",), PAGE_SQL + f"""
, s AS (SELECT page_id, string_agg({_SIG}, '|' ORDER BY pos) AS x, count(*) AS n FROM ol GROUP BY 1)
SELECT page_id, sha256(x) AS hash_value, CAST(length(x) AS INT) AS content_length, CAST(n AS INT) AS element_count FROM s""", recursive=True)
def hash_structure(t):
    out = pg.structure_text(pg.outline(parsed(t)))
    return out.select(
        "page_id", F.sha2("structure_text", 256).alias("hash_value"), F.length("structure_text").alias("content_length"),
        F.size("dom_outline").alias("element_count"),
    )


@query("structure_hash_simple", ("pages_injected",), PAGE_SQL + """
SELECT page_id, sha256(string_agg(tag || ':' || depth || ':' || len(classes), '|' ORDER BY pos)) AS structure_hash FROM ol GROUP BY 1""", recursive=True)
def structure_hash_simple(t):
    out = pg.simple_structure_text(pg.outline(parsed(t)))
    return out.select("page_id", F.sha2("structure_text", 256).alias("structure_hash"))


@query("hash_text_blocks", ("pages_injected",), PAGE_SQL + f"""
, n AS (SELECT page_id, {q.stripped('text')} AS x FROM bl),
s AS (SELECT page_id, coalesce(string_agg(x, chr(10) ORDER BY x) FILTER (x <> ''), '') AS j, count(*) FILTER (x <> '') AS k, count(*) AS o FROM n GROUP BY 1)
SELECT page_id, sha256(j) AS hash_value, CAST(length(j) AS INT) AS content_length, CAST(k AS INT) AS block_count, CAST(o AS INT) AS original_count FROM s""", recursive=True)
def hash_text_blocks(t):
    out = pg.blocks_fingerprint(pg.text_blocks(parsed(t)))
    return out.select("page_id", "hash_value", "content_length", "block_count", "original_count")


PARTS_SQL = f"""
, bx AS (SELECT page_id, array_agg(text ORDER BY pos) AS b FROM bl GROUP BY 1),
pt AS (SELECT p.page_id, main_content AS m, {q.clean(decode_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))} AS ti, array_to_string(b, ' ') AS bt FROM pages_injected p JOIN mc USING (page_id) LEFT JOIN bx USING (page_id)),
pa AS (SELECT page_id, 'main_content' AS content_type, m AS text FROM pt UNION ALL SELECT page_id, 'title', ti FROM pt UNION ALL SELECT page_id, 'text_blocks', bt FROM pt
  UNION ALL SELECT page_id, 'combined', concat_ws(' ', nullif(ti, ''), nullif(m, '')) FROM pt)
"""


@query("vectorize_parts", ("pages_injected",), PAGE_SQL + MAIN_SQL + PARTS_SQL + "SELECT * FROM pa WHERE coalesce(text, '') <> ''", recursive=True)
def vectorize_parts(t):
    return pg.content_parts(pg.extract(t.pages_injected), "page_id")


@query("vectorize_parts_embedded")
def vectorize_parts_embedded(t):
    """The parts with hashed word vectors standing in for a model."""
    parts = pg.content_parts(pg.extract(t.pages_injected), "page_id")
    return stand_in_embedding(parts, "text").select("page_id", "content_type", sim.norm(F.col("embedding")).alias("vector_norm"))


@query("classification_request", ("pages_injected",), PAGE_SQL + MAIN_SQL + f"""
, bx AS (SELECT page_id, array_agg(text ORDER BY pos) AS b FROM bl GROUP BY 1),
v AS (SELECT p.page_id, p.page_id // 10 AS site, main_content AS m, b FROM pages_injected p JOIN mc USING (page_id) LEFT JOIN bx USING (page_id)),
w AS (SELECT *, lag(m) OVER (PARTITION BY site ORDER BY page_id) AS om, lag(b) OVER (PARTITION BY site ORDER BY page_id) AS ob FROM v)
SELECT page_id, array_to_string(list_concat(CASE WHEN m <> '' THEN [m] ELSE [] END, b), chr(10)) AS changed_content,
  coalesce(array_to_string(list_concat(CASE WHEN om <> '' THEN [om] ELSE [] END, ob), chr(10)), '') AS static_context, om IS NOT NULL AS has_baseline FROM w""", recursive=True)
def classification_request(t):
    fields = ["page_id", "url", "title", "meta_description", "word_count", "main_content", "text_blocks"]
    pages = pg.extract(t.pages_injected).select(*fields).withColumn("website_id", F.floor(F.col("page_id") / 10))
    carried = {f"baseline_{c}": F.col(c) for c in ("main_content", "text_blocks")}
    paired = lag_over(pages, ["website_id"], ["page_id"], F.floor(F.col("page_id") / 4096), carried)
    out = vd.classification_request(paired.withColumn("website_name", F.concat(F.lit("Site "), F.col("website_id").cast("string"))))
    return out.select(
        "page_id", F.array_join("changed_content", "\n").alias("changed_content"), F.array_join("static_context", "\n").alias("static_context"),
        (F.get_json_object("site_context", "$.has_baseline") == "true").alias("has_baseline"),
    )


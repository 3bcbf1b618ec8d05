"""Queries over decoded images (8 x 8 pixels, three channels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.operators import visual as vis
from driftwatch.operators.sliced import lag_over
from driftwatch.plans.metrics_queries import rounded
from driftwatch.plans.registry import query


def images(t):
    """One image per three vectors, a channel each; a missing channel is black."""
    values = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.5) * 255).cast("int"))))
    rows = t.embeddings.select(
        F.floor(F.col("vec_id") / 3).alias("image_id"), (F.col("vec_id") % 3).alias("channel"), values.alias("values")
    )
    picked = {c: F.max(F.when(F.col("channel") == i, F.col("values"))) for i, c in enumerate(vis.CHANNELS)}
    wide = rows.groupBy("image_id").agg(*[v.alias(c) for c, v in picked.items()])
    black = F.array_repeat(F.lit(0), 64)
    return wide.withColumns(
        {**{c: F.coalesce(c, black) for c in vis.CHANNELS}, "width": F.lit(8), "height": F.lit(8)}
    )


def pairs(t):
    """Each image beside the one before it at the same site."""
    sited = images(t).withColumn("site", F.col("image_id") % 7)
    old = {f"old_{c}": F.col(c) for c in vis.CHANNELS}
    paired = lag_over(sited, ["site"], ["image_id"], F.floor(F.col("image_id") / 4096), old)
    named = paired.withColumnsRenamed({c: f"new_{c}" for c in vis.CHANNELS})
    return named.filter(F.col("old_r").isNotNull())


IMAGE_SQL = """
, im AS (SELECT DISTINCT image_id // 3 AS image_id FROM pixels),
px AS (SELECT im.image_id, c.ch, p.pos, coalesce(x.v, 0) AS v FROM im, (VALUES (0), (1), (2)) c(ch), (SELECT unnest(range(0, 64)) AS pos) p
  LEFT JOIN pixels x ON x.image_id // 3 = im.image_id AND x.image_id % 3 = c.ch AND x.pos = p.pos)
"""
PAIR_SQL = IMAGE_SQL + """,
pr AS (SELECT a.image_id, a.ch, a.pos, b.v AS o, a.v AS n FROM px a JOIN px b ON b.image_id = a.image_id - 7 AND b.ch = a.ch AND b.pos = a.pos),
ps AS (SELECT image_id, 1 - avg(m) / 255 AS ps FROM (SELECT image_id, ch, avg(abs(o - n)) AS m FROM pr GROUP BY 1, 2) z GROUP BY 1),
hs AS (SELECT image_id, ch, v, count(*) AS k FROM px GROUP BY 1, 2, 3),
grid AS (SELECT image_id, ch, v FROM (SELECT DISTINCT image_id FROM pr) i, (VALUES (0), (1), (2)) c(ch), (SELECT unnest(range(0, 256)) AS v) g),
hc AS (SELECT grid.image_id, greatest(0, coalesce(nullif(corr(CAST(coalesce(a.k, 0) AS DOUBLE), CAST(coalesce(b.k, 0) AS DOUBLE)), 'nan'::DOUBLE), 0)) AS hc FROM grid
  LEFT JOIN hs a ON a.image_id = grid.image_id - 7 AND a.ch = grid.ch AND a.v = grid.v LEFT JOIN hs b ON b.image_id = grid.image_id AND b.ch = grid.ch AND b.v = grid.v GROUP BY 1),
gd AS (SELECT image_id, pos % 8 AS x, pos // 8 AS y, (sum(abs(o - n) * CASE ch WHEN 0 THEN 19595 WHEN 1 THEN 38470 ELSE 7471 END) + 32768) // 65536 AS g FROM pr GROUP BY 1, pos),
ch AS MATERIALIZED (SELECT image_id, x, y FROM gd WHERE g > 25),
ed AS MATERIALIZED (SELECT a.image_id, a.y * 8 + a.x AS p, b.y * 8 + b.x AS q FROM ch a JOIN ch b ON b.image_id = a.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
rc AS (SELECT image_id, y * 8 + x AS p, y * 8 + x AS q FROM ch UNION SELECT rc.image_id, rc.p, ed.q FROM rc JOIN ed ON ed.image_id = rc.image_id AND ed.p = rc.q),
lb AS (SELECT image_id, p, min(q) AS label FROM rc GROUP BY 1, 2),
rg AS (SELECT image_id, min(p % 8) AS x, min(p // 8) AS y, max(p % 8) - min(p % 8) AS w, max(p // 8) - min(p // 8) AS h, count(*) AS area FROM lb GROUP BY image_id, label HAVING count(*) > 6),
sc AS (SELECT image_id, ps, hc, greatest(0.0, least(1.0, ps * CAST(0.7 AS DOUBLE) + hc * CAST(0.3 AS DOUBLE))) AS s, (SELECT count(*) FROM rg WHERE rg.image_id = ps.image_id) AS nr FROM ps JOIN hc USING (image_id))
"""


@query("pixel_similarity", ("pixels",), PAIR_SQL + "SELECT image_id, round(ps, 6) AS pixel_similarity FROM ps", recursive=True)
def pixel_similarity(t):
    return rounded(vis.pixel_similarity(pairs(t)).select("image_id", "pixel_similarity"), "pixel_similarity")


@query("histogram", ("pixels_double",), IMAGE_SQL + """
, b AS (SELECT image_id, unnest(range(0, 768)) AS bin FROM im)
SELECT b.image_id, CAST(b.bin AS INT) AS bin, CAST(count(px.v) AS INT) AS n_pixels FROM b LEFT JOIN px ON px.image_id = b.image_id AND px.ch * 256 + px.v = b.bin GROUP BY 1, 2""")
def histogram(t):
    return vis.histograms(images(t)).select("image_id", F.posexplode("histogram").alias("bin", "n_pixels"))


@query("histogram_correlation", ("pixels",), PAIR_SQL + "SELECT image_id, round(CAST(hc AS DOUBLE), 6) AS histogram_correlation FROM hc", recursive=True)
def histogram_correlation(t):
    return rounded(vis.histogram_correlation(pairs(t)).select("image_id", "histogram_correlation"), "histogram_correlation")


_SUMMARY = """CASE WHEN s >= 0.99 THEN 'No significant visual changes detected' WHEN s >= 0.95 THEN format('Minor visual changes detected ({:.1f}% difference)', (1 - s) * 100)
  ELSE CASE WHEN s >= 0.8 THEN 'Moderate' WHEN s >= 0.5 THEN 'Significant' ELSE 'Major' END || format(' visual changes detected ({:.1f}% difference, {} regions)', (1 - s) * 100, nr) END"""


@query("visual_diff", ("pixels_double",), PAIR_SQL + f"""
SELECT image_id, round(s, 6) AS similarity_score, round((1 - s) * 100, 6) AS difference_percentage, s < 0.8 AS has_significant_change, {_SUMMARY} AS change_summary FROM sc""", recursive=True)
def visual_diff(t):
    out = vis.visual_diff(pairs(t), min_pixels=6)
    return rounded(
        out.select("image_id", "similarity_score", "difference_percentage", "has_significant_change", "change_summary"),
        "similarity_score", "difference_percentage",
    )


@query("changed_regions", ("pixels",), PAIR_SQL + """
SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS width, CAST(h AS INT) AS height, CAST(area AS INT) AS area FROM rg""", recursive=True)
def changed_regions(t):
    out = vis.changed_regions(pairs(t), min_pixels=6)
    rows = out.select("image_id", F.explode_outer("changed_regions").alias("r")).filter("r IS NOT NULL")
    return rows.select("image_id", "r.*")


@query("visual_fingerprint", ("pixels",), IMAGE_SQL + """
, m AS (SELECT image_id, avg(v) FILTER (ch = 0) AS r, avg(v) FILTER (ch = 1) AS g, avg(v) FILTER (ch = 2) AS b FROM px GROUP BY 1),
gr AS (SELECT image_id, pos, (sum(v * CASE ch WHEN 0 THEN 19595 WHEN 1 THEN 38470 ELSE 7471 END) + 32768) // 65536 AS g FROM px GROUP BY 1, 2),
c AS (SELECT image_id, stddev_pop(g) / 255 AS contrast FROM gr GROUP BY 1)
SELECT image_id, 8 AS width, 8 AS height, CAST(1 AS DOUBLE) AS aspect_ratio, 64 AS total_pixels, round(r, 6) AS r_mean, round(g, 6) AS g_mean, round(b, 6) AS b_mean,
  round((r + g + b) / 3 / 255, 6) AS brightness, round(contrast, 6) AS contrast FROM m JOIN c USING (image_id)""")
def visual_fingerprint(t):
    out = vis.visual_fingerprint(images(t)).drop("r", "g", "b")
    return rounded(out, "r_mean", "g_mean", "b_mean", "brightness", "contrast")


@query("viewport_compare", ("pixels",), PAIR_SQL.replace("image_id - 7", "image_id - 3") + """
SELECT im.image_id // 3 AS site, im.image_id % 3 AS viewport, round(CASE WHEN im.image_id // 3 % 4 <> 0 THEN s END, 6) AS similarity_score, CASE WHEN im.image_id // 3 % 4 <> 0 THEN s < 0.8 END AS has_significant_change
FROM im LEFT JOIN sc USING (image_id)""", recursive=True)
def viewport_compare(t):
    shots = images(t).withColumns({"site": F.floor(F.col("image_id") / 3), "viewport": F.col("image_id") % 3})
    baselines = shots.withColumn("site", F.col("site") + 1).filter(F.col("site") % 4 != 0)
    matched = vis.viewport_pairs(shots, baselines, ["site", "viewport"])
    out = vis.visual_diff(matched, min_pixels=6)
    known = F.col("old_r").isNotNull()
    return out.select(
        "site", "viewport", F.when(known, F.round("similarity_score", 6)).alias("similarity_score"),
        F.when(known, F.col("has_significant_change")).alias("has_significant_change"),
    )


@query("screenshot_hash", ("pixels_double",), IMAGE_SQL + """
SELECT image_id, sha256(unhex(string_agg(printf('%02X', v), '' ORDER BY ch, pos))) AS screenshot_hash FROM px GROUP BY 1""")
def screenshot_hash(t):
    values = F.concat(*vis.CHANNELS)
    content = F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return images(t).select("image_id", vis.screenshot_hash(content).alias("screenshot_hash"))

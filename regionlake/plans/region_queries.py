"""Queries over the region, feature and line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import placement, scoring
from ..operators import filters, greedy, lines, regions as ops
from ..params import DetectionParams, PageParams
from .registry import FEATURES, LINES, RECOGNITIONS, REGIONS, TILE_PAGES, query

c = F.col
r6 = lambda x: F.round(x, 6)
REGION_COLS = "page_no, idx, id, x, y, w, h, confidence, kind"


@query("filter_detections", f"WITH {REGIONS} SELECT {REGION_COLS} FROM regions_fx WHERE confidence >= 0.6 AND kind <> 'inline'")
def filter_detections(spark, sf):
    return filters.filter_detections(fx.regions(spark, sf), show="display")


@query("validate_regions", f"""WITH {FEATURES} SELECT {REGION_COLS} FROM features_fx
  WHERE (math_symbols > 0 OR math_font OR greek_count > 0 OR has_fraction OR has_scripts OR has_root OR has_large_ops)
    AND w BETWEEN 20 AND 1000 AND h BETWEEN 10 AND 500 AND confidence >= 0.3""")
def validate_regions(spark, sf):
    return filters.validate_regions(fx.features(spark, sf)).select(*REGION_COLS.split(", "))


@query("size_filter", f"""WITH {FEATURES} SELECT {REGION_COLS} FROM features_fx
  WHERE h BETWEEN 12 AND 300 AND w >= 16 AND ((w >= 24 AND h >= 14) OR has_integral OR has_sum OR has_fraction
    OR has_matrix OR has_root OR has_sup OR has_sub) AND w * h <= 28000 * 0.1""")
def size_filter(spark, sf):
    return filters.filter_by_size(
        fx.features(spark, sf), p=DetectionParams(max_page_share=0.1), page_size=(fx.PAGE_W, fx.PAGE_H)
    ).select(*REGION_COLS.split(", "))


@query("page_and_confidence", f"""WITH {REGIONS} SELECT page_no, id, CASE WHEN idx % 3 <> 0 THEN confidence END AS confidence
  FROM regions_fx WHERE coalesce(CASE WHEN idx % 3 <> 0 THEN confidence END, 1) >= 0.8""")
def page_and_confidence(spark, sf):
    df = fx.regions(spark, sf).withColumn("confidence", F.when(c("idx") % 3 != 0, c("confidence")))
    return filters.filter_page_and_confidence(df, None, 0.8).select("page_no", "id", "confidence")


@query("reproject_boxes", f"""WITH {REGIONS} SELECT page_no, id, round(x / s, 6) AS x, round(y / s, 6) AS y, round(w / s, 6) AS w,
  round(h / s, 6) AS h, round(x / s / 1.5, 6) AS orig_x, round(y / s / 1.5, 6) AS orig_y, round(w / s / 1.5, 6) AS orig_w,
  round(h / s / 1.5, 6) AS orig_h FROM (SELECT *, 1.0 + idx % 3 AS s FROM regions_fx)""")
def reproject_boxes(spark, sf):
    df = fx.regions(spark, sf).withColumns({"image_scale": 1.0 + c("idx") % 3, "render_scale": F.lit(1.5)})
    out = filters.reproject_boxes(df)
    return out.select("page_no", "id", *[r6(c(n)).alias(n) for n in (
        "x", "y", "w", "h", "orig_x", "orig_y", "orig_w", "orig_h")])


@query("choose_resolution", f"""WITH {TILE_PAGES}, s AS (
  SELECT page_id, width, height, CASE WHEN page_id % 7 = 0 THEN NULL ELSE 612.0 END AS pw FROM tile_pages_fx),
  t AS (SELECT *, CASE WHEN pw IS NULL THEN 1.0 ELSE (width / 612.0::DOUBLE + height / 792.0::DOUBLE) / 2 END AS scale FROM s)
  SELECT page_id, round(scale, 6) AS render_scale, round(scale * 72, 6) AS source_dpi,
    round(CASE WHEN width * height <= 4000000 THEN scale * 72
      ELSE least(scale * 72, greatest(96.0, scale * 72 * sqrt(4000000.0 / (width * height)))) END, 6) AS target_dpi FROM t""")
def choose_resolution(spark, sf):
    df = fx.tile_pages(spark, sf).select(
        "page_id", c("width").cast("double").alias("img_w"), c("height").cast("double").alias("img_h"),
        F.when(c("page_id") % 7 != 0, 612.0).alias("page_w"), F.lit(792.0).alias("page_h"))
    return filters.choose_resolution(df).select(
        "page_id", *[r6(c(n)).alias(n) for n in ("render_scale", "source_dpi", "target_dpi")])


@query("crop_boxes", f"""WITH {REGIONS}, t AS (SELECT page_no, id, greatest(0, CAST(floor(x - 10) AS BIGINT)) AS crop_x,
  greatest(0, CAST(floor(y - 10) AS BIGINT)) AS crop_y, x, y, w, h FROM regions_fx),
  u AS (SELECT page_no, id, crop_x, crop_y, least(150 - crop_x, CAST(ceil(w + 20) AS BIGINT)) AS crop_w,
    least(90 - crop_y, CAST(ceil(h + 20) AS BIGINT)) AS crop_h FROM t)
  SELECT * FROM u WHERE crop_w > 0 AND crop_h > 0""")
def crop_boxes(spark, sf):
    df = fx.regions(spark, sf).withColumns({"page_w": F.lit(150.0), "page_h": F.lit(90.0)})
    return filters.crop_boxes(df).select("page_no", "id", "crop_x", "crop_y", "crop_w", "crop_h")


@query("regions_in_viewport", f"""WITH {REGIONS} SELECT {REGION_COLS} FROM regions_fx
  WHERE x <= 90 AND x + w >= 20 AND y <= 70 AND y + h >= 10""")
def regions_in_viewport(spark, sf):
    return filters.regions_in_viewport(fx.regions(spark, sf), 30, 20, 50, 40, buffer=10)


@query("regions_in_viewports", f"""WITH {REGIONS}, v AS (
  SELECT page_no, CAST(n AS INT) AS viewport_id, (n % 4) * 50.0 AS vx, (n // 4) * 35.0 AS vy
  FROM (SELECT DISTINCT page_no FROM regions_fx), range(16) t(n))
  SELECT viewport_id, r.page_no, id FROM regions_fx r JOIN v ON r.page_no = v.page_no
    AND x <= vx + 50 + 5 AND x + w >= vx - 5 AND y <= vy + 35 + 5 AND y + h >= vy - 5""")
def regions_in_viewports(spark, sf):
    df = fx.regions(spark, sf)
    views = df.select("page_no").distinct().withColumn("viewport_id", F.explode(F.sequence(F.lit(0), F.lit(15)))).select(
        "viewport_id", "page_no", ((c("viewport_id") % 4) * 50.0).alias("vx"),
        (F.floor(c("viewport_id") / 4) * 35.0).alias("vy"), F.lit(50.0).alias("vw"), F.lit(35.0).alias("vh"))
    return ops.regions_in_viewports(df, views, buffer=5, cell=64).select("viewport_id", "page_no", "id")


@query("overlap_pairs", f"""WITH {REGIONS}, b AS (
  SELECT page_no, x, y, w, h, min(id) AS id, count(*) AS n FROM regions_fx GROUP BY ALL),
  p AS (SELECT a.page_no, a.id AS id_a, b.id AS id_b, a.n AS copies_a, b.n AS copies_b, a.w * a.h AS sa, b.w * b.h AS sb,
    (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i
    FROM b a JOIN b ON a.page_no = b.page_no AND a.id < b.id AND least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x)
      AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y))
  SELECT page_no, id_a, id_b, copies_a, copies_b, round(i / (sa + sb - i), 6) AS iou, round(i / least(sa, sb), 6) AS overlap FROM p""")
def overlap_pairs(spark, sf):
    return ops.overlap_pairs(fx.regions(spark, sf), cell=64).withColumns({"iou": r6(c("iou")), "overlap": r6(c("overlap"))})


_AREA = "CASE WHEN least(k.x + k.w, r.x + r.w) > greatest(k.x, r.x) AND least(k.y + k.h, r.y + r.h) > greatest(k.y, r.y) THEN (least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x)) * (least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y)) ELSE 0 END"
_IOU_HIT = f"(({_AREA}) / (k.w * k.h + r.w * r.h - ({_AREA})) > 0.5)"
_OVERLAP_HIT = f"(({_AREA}) / least(k.w * k.h, r.w * r.h) > 0.3)"


@query("nms", f"""WITH RECURSIVE {REGIONS},
  ranked AS (SELECT page_no, id, x, y, w, h, row_number() OVER (PARTITION BY page_no ORDER BY confidence DESC, id) AS n FROM regions_fx),
  walk AS (
    SELECT page_no, n, [{{'id': id, 'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM ranked WHERE n = 1
    UNION ALL
    SELECT r.page_no, r.n, CASE WHEN len(list_filter(walk.kept, lambda k: {_IOU_HIT})) > 0 THEN walk.kept
      ELSE list_append(walk.kept, {{'id': r.id, 'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h}}) END
    FROM walk JOIN ranked r ON r.page_no = walk.page_no AND r.n = walk.n + 1),
  last AS (SELECT page_no, max_by(kept, n) AS kept FROM walk GROUP BY page_no),
  ids AS (SELECT page_no, unnest(kept).id AS id FROM last)
  SELECT {', '.join('r.' + x for x in REGION_COLS.split(', '))} FROM regions_fx r JOIN ids USING (page_no, id)""")
def nms(spark, sf):
    return greedy.nms(fx.regions(spark, sf))


@query("merge_overlaps", f"""WITH RECURSIVE {REGIONS},
  walk AS (
    SELECT page_no, idx, [{{'s': idx, 'x': x, 'y': y, 'w': w, 'h': h}}] AS seeds, idx AS seed FROM regions_fx WHERE idx = 1
    UNION ALL
    SELECT page_no, idx, CASE WHEN hit IS NULL THEN list_append(seeds, {{'s': idx, 'x': x, 'y': y, 'w': w, 'h': h}}) ELSE seeds END,
      coalesce(hit, idx)
    FROM (SELECT r.page_no, r.idx, r.x, r.y, r.w, r.h, walk.seeds, list_filter(walk.seeds, lambda k: {_OVERLAP_HIT})[1].s AS hit
      FROM walk JOIN regions_fx r ON r.page_no = walk.page_no AND r.idx = walk.idx + 1))
  SELECT w.page_no, w.seed AS seed_idx, min(r.x) AS x, min(r.y) AS y, max(r.x + r.w) - min(r.x) AS w,
    max(r.y + r.h) - min(r.y) AS h, count(*) AS n_merged
  FROM walk w JOIN regions_fx r ON r.page_no = w.page_no AND r.idx = w.idx GROUP BY w.page_no, w.seed""")
def merge_overlaps(spark, sf):
    return greedy.merge_overlaps(fx.regions(spark, sf))


@query("union_boxes", f"""WITH {REGIONS} SELECT page_no, kind, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h
  FROM regions_fx GROUP BY page_no, kind""")
def union_boxes(spark, sf):
    return fx.regions(spark, sf).groupBy("page_no", "kind").agg(*greedy.union_box())


_ORDER = """,
  a AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page_no ORDER BY y, id) > 20 THEN 1 ELSE 0 END AS brk FROM regions_fx),
  b AS (SELECT *, CAST(1 + sum(brk) OVER (PARTITION BY page_no ORDER BY y, id ROWS UNBOUNDED PRECEDING) AS INT) AS line_no FROM a)"""


@query("reading_order", f"""WITH {REGIONS}{_ORDER}
  SELECT page_no, id, line_no, CAST(row_number() OVER (PARTITION BY page_no ORDER BY line_no, x, id) AS INT) AS position FROM b""")
def reading_order(spark, sf):
    return ops.reading_order(fx.regions(spark, sf)).select("page_no", "id", "line_no", "position")


@query("number_regions", f"""WITH {REGIONS} SELECT page_no, id,
  CAST(row_number() OVER (PARTITION BY page_no ORDER BY idx, id) AS INT) AS number FROM regions_fx""")
def number_regions(spark, sf):
    return ops.number_regions(fx.regions(spark, sf), ["page_no"], ["idx", "id"]).select("page_no", "id", "number")


@query("confidence_bands", f"""WITH {REGIONS}, r AS (SELECT * FROM regions_fx WHERE confidence >= 0.6),
  b AS (SELECT page_no, max(confidence) AS best FROM r GROUP BY page_no)
  SELECT page_no, id, confidence, CAST(confidence < best - (best - 0.6) / 3 AS INT) + CAST(confidence < best - (best - 0.6) / 3 * 2 AS INT) AS band
  FROM r JOIN b USING (page_no)""")
def confidence_bands(spark, sf):
    return ops.confidence_bands(fx.regions(spark, sf), 3, 0.6).select("page_no", "id", "confidence", "band")


@query("top_k_per_page", f"""WITH {REGIONS} SELECT * FROM (SELECT page_no, id, confidence,
  CAST(row_number() OVER (PARTITION BY page_no ORDER BY confidence DESC, id) AS INT) AS rank FROM regions_fx) WHERE rank <= 3""")
def top_k_per_page(spark, sf):
    return ops.top_k(fx.regions(spark, sf).select("page_no", "id", "confidence"), 3)


@query("top_k_global", f"WITH {REGIONS} SELECT page_no, id, confidence FROM regions_fx ORDER BY confidence DESC, id LIMIT 5")
def top_k_global(spark, sf):
    return ops.top_k(fx.regions(spark, sf).select("page_no", "id", "confidence"), 5, page=None)


_CONTEXT = f"""WITH {REGIONS}, {LINES},
  near AS (SELECT r.page_no, r.id, min_by((line_no, line_y, line_h), (abs(r.y + r.h / 2 - (line_y + line_h / 2)), line_no)) AS l
    FROM regions_fx r JOIN page_lines_fx USING (page_no) GROUP BY r.page_no, r.id),
  ctx AS (SELECT r.page_no, r.id, count(line_no) AS n_lines, avg(line_h) AS avg_line_h,
      NOT coalesce(bool_or(line_y + line_h > r.y - r.h * 0.5 AND line_y + line_h < r.y), false) AS space_above,
      NOT coalesce(bool_or(line_y > r.y + r.h AND line_y < r.y + r.h * 1.5), false) AS space_below,
      coalesce(bool_or(NOT (r.y + r.h < line_y OR r.y > line_y + line_h)), false) AS overlaps_line,
      count(*) FILTER (abs(r.y + r.h / 2 - (line_y + line_h / 2)) < line_h * 2) AS n_near
    FROM regions_fx r LEFT JOIN page_lines_fx p ON r.page_no = p.page_no GROUP BY r.page_no, r.id, r.y, r.h),
  c AS (SELECT r.page_no, r.id, r.x, r.y, r.w, r.h, n_lines, avg_line_h, space_above, space_below, overlaps_line, n_near,
      l[1] AS near_no, l[2] AS near_y, l[3] AS near_h, abs(r.y + r.h / 2 - (l[2] + l[3] / 2)) AS near_distance
    FROM regions_fx r JOIN ctx USING (page_no, id) LEFT JOIN near USING (page_no, id))"""


@query("text_line_context", _CONTEXT + """ SELECT page_no, id, n_lines, avg_line_h, space_above, space_below, overlaps_line,
  n_near, near_no, near_y, near_h, near_distance FROM c""")
def text_line_context(spark, sf):
    return lines.text_line_context(fx.regions(spark, sf), fx.page_lines(spark, sf)).drop(
        "idx", "x", "y", "w", "h", "confidence", "kind")


@query("nearest_text_line", _CONTEXT + """ SELECT page_no, id, near_no, near_distance, CASE
    WHEN near_y IS NULL OR near_distance > near_h * 2 THEN 'isolated'
    WHEN y + h / 2 < near_y + near_h / 2 - near_h * 0.3 THEN 'top'
    WHEN y + h / 2 > near_y + near_h / 2 + near_h * 0.3 THEN 'bottom' ELSE 'middle' END AS vertical_alignment FROM c""")
def nearest_text_line(spark, sf):
    return lines.nearest_text_line(fx.regions(spark, sf), fx.page_lines(spark, sf)).select(
        "page_no", "id", "near_no", "near_distance", "vertical_alignment")


_TYPE = """, s AS (SELECT *,
    CASE WHEN n_lines = 0 OR (space_above AND space_below) THEN 0.4::DOUBLE ELSE 0 END
    + CASE WHEN abs(x + w / 2 - 100) < 40 THEN 0.3::DOUBLE ELSE 0 END
    + CASE WHEN CASE WHEN n_lines = 0 THEN h > 40 ELSE h > avg_line_h * 1.5 END THEN 0.2::DOUBLE ELSE 0 END
    + CASE WHEN n_lines = 0 OR NOT overlaps_line THEN 0.1::DOUBLE ELSE 0 END AS d,
    CASE WHEN n_lines > 0 AND abs(y + h / 2 - (near_y + near_h / 2)) < near_h THEN 0.4::DOUBLE ELSE 0 END
    + CASE WHEN CASE WHEN n_lines = 0 THEN h < 30 ELSE h < avg_line_h * 1.2 END THEN 0.3::DOUBLE ELSE 0 END
    + CASE WHEN n_lines >= 2 AND n_near >= 2 THEN 0.2::DOUBLE ELSE 0 END
    + CASE WHEN n_lines > 0 AND abs(y + h - (near_y + near_h)) < near_h * 0.3 THEN 0.1::DOUBLE ELSE 0 END AS i FROM c)"""


@query("formula_type", _CONTEXT + _TYPE + """ SELECT page_no, id, CASE WHEN d > i THEN 'display' ELSE 'inline' END AS kind,
  round(CASE WHEN d + i > 0 THEN greatest(d, i) / (d + i) END, 6) AS kind_confidence FROM s""")
def formula_type(spark, sf):
    rows = lines.text_line_context(fx.regions(spark, sf), fx.page_lines(spark, sf))
    return placement.classify_kind(rows, F.lit(fx.PAGE_W)).select(
        "page_no", "id", "kind", r6(c("kind_confidence")).alias("kind_confidence"))


@query("page_context", f"""WITH {REGIONS} SELECT page_no, round(sum(w * h) / 28000, 6) AS formula_density,
  round(sum(w * h) / count(*), 6) AS avg_size, count(*) AS n_formulas FROM regions_fx GROUP BY page_no""")
def page_context(spark, sf):
    out = ops.page_context(fx.regions(spark, sf), F.lit(fx.PAGE_W * fx.PAGE_H))
    return out.withColumns({"formula_density": r6(c("formula_density")), "avg_size": r6(c("avg_size"))})


_STRUCT = """least(1, CASE WHEN has_fraction THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN has_scripts THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN has_root OR has_large_ops THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN has_brackets THEN 0.2::DOUBLE ELSE 0 END)"""


@query("text_confidence", f"""WITH {FEATURES}, g AS (SELECT page_no, sum(w * h) / 28000 AS dens FROM features_fx GROUP BY page_no),
  s AS (SELECT page_no, id, least(1, least(0.5::DOUBLE, math_symbols * 0.1::DOUBLE) + CASE WHEN math_font THEN 0.2::DOUBLE ELSE 0 END
      + least(0.3::DOUBLE, greek_count * 0.05::DOUBLE)) AS f, {_STRUCT} AS st,
    least(1, CASE WHEN kind = 'inline' THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN dens > 0.1 THEN 0.2::DOUBLE ELSE 0 END + 0.8::DOUBLE * 0.3::DOUBLE) AS ct,
    greatest(0, least(1, CASE WHEN w BETWEEN 20 AND 500 AND h BETWEEN 10 AND 200 THEN 0.3::DOUBLE WHEN w < 20 OR h < 10 THEN -0.2::DOUBLE ELSE -0.1::DOUBLE END
      + CASE WHEN w / h BETWEEN 1 AND 10 THEN 0.4::DOUBLE ELSE 0 END + 0.3::DOUBLE)) AS b
    FROM features_fx JOIN g USING (page_no))
  SELECT page_no, id, round(greatest(0, least(1, f * 0.4::DOUBLE + st * 0.3::DOUBLE + ct * 0.2::DOUBLE + b * 0.1::DOUBLE)), 6) AS score FROM s""")
def text_confidence(spark, sf):
    df = fx.features(spark, sf)
    ctx = ops.page_context(df, F.lit(fx.PAGE_W * fx.PAGE_H)).select("page_no", "formula_density")
    p = PageParams()
    return df.join(ctx, "page_no").select("page_no", "id", r6(scoring.text_confidence(
        F.lit(p.page_type), c("formula_density"), F.lit(p.text_quality))).alias("score"))


_ANY = "(has_integral OR has_sum OR has_fraction OR has_matrix OR has_root OR has_greek OR has_sup OR has_sub)"
_STRONG4 = "(has_integral OR has_sum OR has_fraction OR has_matrix)"


def _pt(cond: str, v: float) -> str:
    return f"CASE WHEN {cond} THEN {v}::DOUBLE ELSE 0 END"


_CLASS = f""", raw AS (SELECT *, vertical_complexity AS vc,
    (CAST(has_sup AS INT) + CAST(has_sub AS INT) + CAST(has_root AS INT)) AS med,
    {_pt('vertical_complexity >= 0.3', 0.15)} + {_pt('has_sup AND has_sub', 0.1)} + {_pt('has_sup OR has_sub', 0.05)} AS bonus,
    CASE WHEN w / h >= 3 AND h <= 50 AND NOT {_ANY} AND density <= 0.3 THEN 1
      WHEN w <= 400 AND h <= 40 AND NOT {_ANY} AND density <= 0.25 THEN 2
      WHEN w / h >= 2 AND h <= 60 AND NOT (has_fraction OR has_matrix OR (has_sup AND has_sub) OR has_root) AND vertical_complexity <= 0.3 THEN 3
      WHEN w >= 200 AND w / h >= 2 AND NOT {_ANY} AND vertical_complexity <= 0.4 THEN 4
      WHEN w >= 150 AND h >= 150 AND density >= 0.5 AND edge_density <= 0.4 AND NOT (has_greek OR has_sup OR has_sub) THEN 5 ELSE 0 END AS rule
    FROM features_fx),
  sc AS (SELECT *,
    CASE WHEN {_STRONG4} OR has_root THEN least(1, 0.5::DOUBLE + ({_pt('has_integral', 0.15)} + {_pt('has_sum', 0.15)} + {_pt('has_fraction', 0.1)}
        + {_pt('has_matrix', 0.1)} + {_pt('has_root', 0.1)}) + bonus)
      WHEN med = 0 THEN CASE WHEN has_greek THEN 0.08::DOUBLE ELSE 0.05::DOUBLE END
      ELSE least(1, 0.25::DOUBLE + med * 0.2::DOUBLE + {_pt('has_greek', 0.05)} + bonus) END AS f,
    least(1, {_pt('density > 0.6 AND edge_density < 0.3', 0.5)} + {_pt('w > 200 AND h > 200', 0.3)}
      + {_pt('NOT (has_greek OR has_sup OR has_sub OR has_fraction)', 0.2)}) AS im,
    least(1, {_pt('has_grid', 0.6)} + {_pt('vc > 0.5 AND aspect > 1', 0.2)} + {_pt('density > 0.2 AND density < 0.5', 0.2)}) AS tb,
    least(1, ({_pt('vc < 0.3', 0.4)} + {_pt('aspect > 2 AND aspect < 10', 0.3)} + {_pt(f'NOT {_STRONG4}', 0.3)})
      * CASE WHEN {_STRONG4} OR has_root OR has_sup OR has_sub THEN 0.6::DOUBLE ELSE 1 END) AS tx FROM raw),
  cls AS (SELECT *, CASE WHEN rule BETWEEN 1 AND 4 THEN 'text' WHEN rule = 5 THEN 'image'
      WHEN f = greatest(f, im, tb, tx) THEN 'formula' WHEN im = greatest(f, im, tb, tx) THEN 'image'
      WHEN tb = greatest(f, im, tb, tx) THEN 'table' ELSE 'text' END AS content_class,
    CASE rule WHEN 1 THEN 0.97::DOUBLE WHEN 2 THEN 0.94::DOUBLE WHEN 3 THEN 0.9::DOUBLE WHEN 4 THEN 0.85::DOUBLE WHEN 5 THEN 0.94::DOUBLE
      ELSE greatest(f, im, tb, tx) / (f + im + tb + tx) END AS certainty FROM sc)"""


def _classified(spark, sf):
    return scoring.classify_content(fx.features(spark, sf))


@query("content_class", f"WITH {FEATURES}{_CLASS} SELECT page_no, id, content_class, round(certainty, 6) AS certainty FROM cls")
def content_class(spark, sf):
    return _classified(spark, sf).select("page_no", "id", "content_class", r6(c("certainty")).alias("certainty"))


@query("content_reasons", f"""WITH {FEATURES}{_CLASS}, reasons AS (SELECT CASE
    WHEN rule = 1 THEN ['检测为标题：宽度过大，高度较小，无数学符号特征', '高度统一', '线性布局', '无数学符号']
    WHEN rule = 2 THEN ['检测为作者信息：短文本，无数学符号'] WHEN rule = 3 THEN ['检测为图片说明：文本特征明显，无复杂数学结构']
    WHEN rule = 4 THEN ['检测为文本段落：宽度大，无明显数学特征', '线性布局', '无数学符号']
    WHEN rule = 5 THEN ['像素密度高', '边缘密度低', '连续色调', '无明显数学符号'] ELSE list_filter(CASE content_class
      WHEN 'formula' THEN [CASE WHEN has_integral THEN '包含积分符号' END, CASE WHEN has_sum THEN '包含求和符号' END,
        CASE WHEN has_fraction THEN '包含分数线' END, CASE WHEN has_matrix THEN '检测到矩阵括号' END, CASE WHEN has_root THEN '包含根号' END,
        CASE WHEN has_greek THEN '检测到希腊字母' END, CASE WHEN has_sup AND has_sub THEN '检测到上下标' END, CASE WHEN vc >= 0.3 THEN '垂直结构复杂' END]
      WHEN 'text' THEN [CASE WHEN vc < 0.3 THEN '线性布局' END, CASE WHEN aspect > 2 THEN '横向文本' END,
        CASE WHEN uniformity > 0.8 THEN '高度统一' END, CASE WHEN NOT {_STRONG4} THEN '无数学符号' END]
      WHEN 'image' THEN [CASE WHEN density > 0.4 THEN '像素密度高' END, CASE WHEN edge_density < 0.3 THEN '边缘密度低' END, '连续色调',
        CASE WHEN NOT (has_integral OR has_sum OR has_greek) THEN '无明显数学符号' END]
      ELSE [CASE WHEN has_grid THEN '检测到网格线结构' END, '规则布局', CASE WHEN vc > 0.5 THEN '多行结构' END] END, lambda s: s IS NOT NULL) END AS r FROM cls)
  SELECT reason, count(*) AS n FROM (SELECT unnest(r) AS reason FROM reasons) GROUP BY reason""")
def content_reasons(spark, sf):
    return _classified(spark, sf).select(F.explode("reasoning").alias("reason")).filter(
        ~c("reason").startswith("置信度")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_PIXEL = f""", m AS (SELECT *, CASE WHEN content_class = 'formula' THEN least(1, {_pt('has_integral', 0.25)} + {_pt('has_sum', 0.25)}
      + {_pt('has_fraction', 0.25)} + {_pt('has_matrix', 0.25)} + ({_pt('has_greek', 0.125)} + {_pt('has_sup', 0.125)} + {_pt('has_sub', 0.125)}
      + {_pt('has_root', 0.125)}) + {_pt('vc > 0.3', 0.1)} + {_pt('density > 0.05 AND density < 0.5', 0.1)}) ELSE 0.5::DOUBLE END AS fm,
    least(1, 0.5::DOUBLE + CASE WHEN kind = 'display' THEN {_pt('h > 30', 0.2)} + {_pt('vc > 0.3', 0.15)}
      ELSE {_pt('h < 30', 0.2)} + {_pt('vc < 0.5', 0.15)} END + confidence * 0.15::DOUBLE) AS cc FROM cls),
  px AS (SELECT *, fm * 0.4::DOUBLE + certainty * 0.3::DOUBLE + tightness * 0.2::DOUBLE + cc * 0.1::DOUBLE AS score FROM m)"""


def _scored(spark, sf):
    return _classified(spark, sf).withColumn("score", scoring.pixel_confidence(
        c("content_class"), c("certainty"), c("tightness"), c("kind"), c("confidence")))


@query("pixel_confidence", f"""WITH {FEATURES}{_CLASS}{_PIXEL} SELECT page_no, id, round(score, 9) AS score,
  CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.75 THEN 'medium' ELSE 'low' END AS level FROM px""")
def pixel_confidence(spark, sf):
    return _scored(spark, sf).select("page_no", "id", F.round(c("score"), 9).alias("score"), scoring.level(c("score")).alias("level"))


@query("detections_by_class", f"""WITH {FEATURES}{_CLASS}{_PIXEL} SELECT content_class, count(*) AS candidates,
  round(avg(certainty), 6) AS avg_certainty, count(*) FILTER (h BETWEEN 12 AND 300 AND w >= 16) AS size_ok,
  count(*) FILTER (h BETWEEN 12 AND 300 AND w >= 16 AND content_class = 'formula') AS formulas,
  count(*) FILTER (h BETWEEN 12 AND 300 AND w >= 16 AND content_class = 'formula' AND score >= 0.6) AS kept FROM px GROUP BY content_class""")
def detections_by_class(spark, sf):
    rows = _scored(spark, sf).withColumn("confidence", c("score"))
    return ops.detections_by_class(rows).withColumn("avg_certainty", r6(c("avg_certainty")))


@query("complexity", f"""WITH {FEATURES} SELECT page_no, id, CASE WHEN n >= 3 THEN 'complex' WHEN n >= 1 THEN 'medium' ELSE 'simple' END AS complexity
  FROM (SELECT *, CAST(has_fraction AS INT) + CAST(has_scripts AS INT) + CAST(has_root AS INT) + CAST(has_large_ops AS INT)
    + CAST(has_brackets AS INT) AS n FROM features_fx)""")
def complexity(spark, sf):
    return fx.features(spark, sf).select("page_no", "id", scoring.complexity().alias("complexity"))


@query("pixel_to_text_features", f"""WITH {FEATURES} SELECT page_no, id, CASE WHEN has_large_ops THEN 5 ELSE 0 END AS math_symbols,
  CASE WHEN has_greek THEN 3 ELSE 0 END AS greek_count, CASE WHEN has_large_ops THEN 2 ELSE 0 END AS operator_count, has_greek AS math_font,
  has_sup OR has_sub AS has_scripts, has_integral OR has_sum AS has_large_ops, has_matrix AS has_brackets FROM features_fx""")
def pixel_to_text_features(spark, sf):
    return fx.features(spark, sf).select(
        "page_no", "id", *[v.alias(k) for k, v in scoring.text_features_of_pixels().items()])


@query("horizontal_alignment", f"""WITH {REGIONS} SELECT page_no, id, CASE WHEN (x + w / 2) / 200 < 0.33 THEN 'left'
  WHEN (x + w / 2) / 200 > 0.67 THEN 'right' ELSE 'center' END AS alignment, least(1, n / 10.0::DOUBLE) AS density
  FROM regions_fx JOIN (SELECT page_no, count(*) - 1 AS n FROM regions_fx GROUP BY page_no) USING (page_no)""")
def horizontal_alignment(spark, sf):
    from ..functions.geometry import horizontal_alignment as align
    df = fx.regions(spark, sf)
    n = df.groupBy("page_no").agg((F.count(F.lit(1)) - 1).alias("n"))
    return df.join(n, "page_no").select(
        "page_no", "id", align(c("x"), c("w"), F.lit(fx.PAGE_W)).alias("alignment"),
        F.least(F.lit(1.0), c("n") / 10.0).alias("density"))


@query("detection_stats", f"""WITH {REGIONS} SELECT page_no, count(*) AS total, count(*) FILTER (kind = 'display') AS display,
  count(*) FILTER (kind <> 'display') AS inline, count(*) FILTER (confidence >= 0.9) AS high,
  count(*) FILTER (confidence >= 0.75 AND confidence < 0.9) AS medium, count(*) FILTER (confidence < 0.75) AS low,
  round(avg(confidence), 6) AS avg_confidence FROM regions_fx GROUP BY page_no""")
def detection_stats(spark, sf):
    return ops.detection_stats(fx.regions(spark, sf), ["page_no"]).withColumn("avg_confidence", r6(c("avg_confidence")))


@query("status_counts", f"""WITH {RECOGNITIONS}, t AS (SELECT r.page_no, kind, coalesce(status, 'pending') AS status
  FROM regions_fx r LEFT JOIN recognitions_fx q USING (id))
  SELECT page_no, count(*) AS shown, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'processing') AS processing,
    count(*) FILTER (status NOT IN ('done', 'processing')) AS pending, count(*) FILTER (kind = 'display') AS display,
    count(*) FILTER (kind = 'inline') AS inline FROM t GROUP BY page_no""")
def status_counts(spark, sf):
    return ops.status_counts(fx.regions(spark, sf), fx.recognitions(spark, sf), partitions=fx.region_partitions(spark, sf))


@query("page_counts", f"""WITH {REGIONS}, p AS (SELECT DISTINCT page_no FROM regions_fx),
  k AS (SELECT page_no, count(*) AS n FROM regions_fx WHERE confidence >= 0.9 GROUP BY page_no)
  SELECT page_no, coalesce(n, 0) AS n_regions FROM p LEFT JOIN k USING (page_no)""")
def page_counts(spark, sf):
    df = fx.regions(spark, sf)
    return ops.page_counts(df.select("page_no").distinct(), df.filter("confidence >= 0.9"))


@query("attach_recognitions", f"""WITH {RECOGNITIONS} SELECT r.id, coalesce(status, 'pending') AS status, latex
  FROM regions_fx r LEFT JOIN recognitions_fx q USING (id)""")
def attach_recognitions(spark, sf):
    return ops.attach_recognitions(
        fx.regions(spark, sf), fx.recognitions(spark, sf), partitions=fx.region_partitions(spark, sf)).select("id", "status", "latex")


@query("pending_regions", f"""WITH {RECOGNITIONS} SELECT page_no, id FROM regions_fx r
  WHERE NOT EXISTS (SELECT 1 FROM recognitions_fx q WHERE q.id = r.id AND status NOT IN ('pending', 'error'))""")
def pending_regions(spark, sf):
    return ops.pending_regions(
        fx.regions(spark, sf), fx.recognitions(spark, sf), fx.region_partitions(spark, sf)).select("page_no", "id")


@query("delete_by_ids", f"WITH {RECOGNITIONS} SELECT page_no, id FROM regions_fx WHERE id NOT IN (SELECT id FROM recognitions_fx WHERE status = 'error')")
def delete_by_ids(spark, sf):
    gone = fx.recognitions(spark, sf).filter("status = 'error'")
    return ops.delete_by_ids(fx.regions(spark, sf), gone, partitions=fx.region_partitions(spark, sf)).select("page_no", "id")


@query("select_by_ids", f"WITH {RECOGNITIONS} SELECT page_no, id FROM regions_fx WHERE id IN (SELECT id FROM recognitions_fx WHERE status = 'error')")
def select_by_ids(spark, sf):
    chosen = fx.recognitions(spark, sf).filter("status = 'error'")
    return ops.select_by_ids(fx.regions(spark, sf), chosen, partitions=fx.region_partitions(spark, sf)).select("page_no", "id")


_FOLD = """(CASE WHEN (NOT cur.has_crop AND r.has_crop) OR r.confidence > cur.confidence + 0.01
      THEN {'id': r.id, 'has_crop': r.has_crop, 'confidence': r.confidence} ELSE cur END)"""


@query("merge_by_position", f"""WITH {REGIONS},
  t AS (SELECT page_no, id, idx, confidence, idx % 4 = 0 AS has_crop, floor(x / 40) AS kx, floor(y / 40) AS ky, idx % 2 = 0 AS incoming FROM regions_fx),
  base AS (SELECT page_no, kx, ky, max_by({{'id': id, 'has_crop': has_crop, 'confidence': confidence}}, idx) AS b FROM t WHERE NOT incoming GROUP BY ALL),
  inc AS (SELECT page_no, kx, ky, list({{'id': id, 'has_crop': has_crop, 'confidence': confidence}} ORDER BY idx) AS l FROM t WHERE incoming GROUP BY ALL),
  j AS (SELECT page_no, kx, ky, list_concat(CASE WHEN b IS NULL THEN [] ELSE [b] END, coalesce(l, [])) AS l FROM base FULL JOIN inc USING (page_no, kx, ky)),
  f AS (SELECT page_no, list_reduce(l, lambda cur, r: {_FOLD}) AS o FROM j)
  SELECT page_no, o.id AS id, o.has_crop AS has_crop, o.confidence AS confidence FROM f""")
def merge_by_position(spark, sf):
    # coarse positions, so that many rows share one
    df = fx.regions(spark, sf).select(
        "page_no", "id", c("idx").alias("seq"), "confidence", (c("idx") % 4 == 0).alias("has_crop"),
        F.floor(c("x") / 40).cast("double").alias("x"), F.floor(c("y") / 40).cast("double").alias("y"),
        F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    out = ops.merge_by_position(df.filter("seq % 2 = 1"), df.filter("seq % 2 = 0"))
    return out.select("page_no", "id", "has_crop", "confidence")


@query("text_or_pixel", f"""WITH {REGIONS}, tiles AS (SELECT DISTINCT page_no, idx % 2 AS tile_no, CASE WHEN page_no % 2 = 0 THEN 1300 ELSE 900 END AS side FROM regions_fx),
  d AS (SELECT page_no, idx % 2 AS tile_no, id, CASE WHEN l_suppkey % 3 = 0 THEN 'text' ELSE 'pixel' END AS detected_by FROM regions_fx),
  f AS (SELECT page_no, tile_no, count(*) FILTER (detected_by = 'text') AS t, count(*) FILTER (detected_by = 'pixel') AS p FROM d GROUP BY ALL)
  SELECT page_no, tile_no, id, detected_by FROM d JOIN f USING (page_no, tile_no) JOIN tiles USING (page_no, tile_no)
  WHERE detected_by = CASE WHEN t > 0 AND (side * side > 1200000 OR p = 0) THEN 'text' ELSE 'pixel' END""")
def text_or_pixel(spark, sf):
    rows = fx._numbered(spark, sf).select(
        c("l_orderkey").alias("page_no"), (c("idx") % 2).alias("tile_no"),
        F.concat(c("l_orderkey").cast("string"), F.lit("-"), c("idx").cast("string")).alias("id"),
        (c("l_suppkey") % 3 == 0).alias("is_text"))
    side = F.when(c("page_no") % 2 == 0, 1300).otherwise(900)
    tiles = rows.select("page_no", "tile_no").distinct().withColumns({"tile_w": side, "tile_h": side})
    return ops.text_or_pixel(rows.filter("is_text").drop("is_text"), rows.filter("NOT is_text").drop("is_text"), tiles)


@query("concat_detections", f"WITH {REGIONS} SELECT page_no, id FROM regions_fx WHERE idx % 2 = 0 UNION ALL SELECT page_no, id FROM regions_fx WHERE idx % 2 = 1")
def concat_detections(spark, sf):
    df = fx.regions(spark, sf).select("page_no", "id", "idx")
    return ops.concat_detections(df.filter("idx % 2 = 0"), df.filter("idx % 2 = 1")).drop("idx")


_TILES = """, g AS (SELECT page_id, width, height, width * height < 6000000 AS small,
    CASE WHEN width * height < 6000000 THEN 1 ELSE CAST(ceil(width / 1000.0) AS BIGINT) END AS nc,
    CASE WHEN width * height < 6000000 THEN 1 ELSE CAST(ceil(height / 1000.0) AS BIGINT) END AS nr FROM tile_pages_fx),
  tl AS (SELECT page_id, width, height, small, r * nc + k AS tile_no, greatest(0, k * 1000 - 100) AS tile_x, greatest(0, r * 1000 - 100) AS tile_y
    FROM g, LATERAL (SELECT unnest(range(nr)) AS r), LATERAL (SELECT unnest(range(nc)) AS k)),
  tiles AS (SELECT page_id, tile_no, tile_x, tile_y, CASE WHEN small THEN width ELSE least(1200, width - tile_x) END AS tile_w,
    CASE WHEN small THEN height ELSE least(1200, height - tile_y) END AS tile_h FROM tl)"""


@query("tile_pages", f"WITH {TILE_PAGES}{_TILES} SELECT page_id, tile_no, tile_x, tile_y, tile_w, tile_h FROM tiles")
def tile_pages(spark, sf):
    return ops.tile_grid(fx.tile_pages(spark, sf)).select("page_id", "tile_no", "tile_x", "tile_y", "tile_w", "tile_h")


@query("text_in_tiles", f"""WITH {TILE_PAGES}{_TILES}, items AS (SELECT page_id, CAST(n AS INT) AS item, (page_id * 131 + n * 977) % width AS x,
    (page_id * 17 + n * 613) % height AS y FROM tile_pages_fx, range(10) t(n))
  SELECT i.page_id, item, tile_no FROM items i JOIN tiles t ON i.page_id = t.page_id AND x >= tile_x AND x < tile_x + tile_w
    AND y >= tile_y AND y < tile_y + tile_h""")
def text_in_tiles(spark, sf):
    pages = fx.tile_pages(spark, sf)
    items = pages.withColumn("item", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
        "page_id", "item", ((c("page_id") * 131 + c("item") * 977) % c("width")).alias("x"),
        ((c("page_id") * 17 + c("item") * 613) % c("height")).alias("y"))
    return ops.assign_to_tiles(items, pages).select("page_id", "item", "tile_no")

"""Named queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..deploy import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _with_package(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = _with_package(fn)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- SQL of the derived inputs
REGIONS = """
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_quantity) AS INT) AS idx FROM lineitem),
regions_fx AS (
  SELECT l_orderkey AS page_no, idx, concat(CAST(l_orderkey AS VARCHAR), '-', CAST(idx AS VARCHAR)) AS id,
    CAST((l_partkey * 37) % 120 AS DOUBLE) AS x, CAST((l_suppkey * 53) % 80 AS DOUBLE) AS y,
    20 + l_quantity AS w, CAST(12 + (l_linenumber * 7) % 40 AS DOUBLE) AS h,
    round(0.5 + l_discount * 5, 4) AS confidence,
    CASE l_returnflag WHEN 'A' THEN 'display' WHEN 'N' THEN 'inline' ELSE 'numbered' END AS kind,
    l_partkey, l_suppkey, l_discount, l_tax, l_quantity
  FROM numbered)"""

FEATURES = REGIONS + """,
features_fx AS (
  SELECT page_no, idx, id, x, y, w, h, confidence, kind,
    l_partkey % 11 = 0 AS has_integral, l_partkey % 7 = 0 AS has_sum, l_suppkey % 5 = 0 AS has_fraction,
    l_partkey % 13 = 0 AS has_matrix, l_suppkey % 9 = 0 AS has_root, l_partkey % 3 = 0 AS has_greek,
    l_partkey % 4 = 0 AS has_sup, l_suppkey % 4 = 0 AS has_sub, l_discount * 6 AS density,
    (l_tax + 0.0) * 10 AS vertical_complexity, l_quantity / 100 AS edge_density, 1 - (l_tax + 0.0) AS uniformity,
    l_discount * 10 AS tightness, l_partkey % 17 = 0 AS has_grid, l_partkey % 6 AS math_symbols,
    l_suppkey % 4 AS greek_count, w / h AS aspect, l_partkey % 3 = 0 AS math_font,
    (l_partkey % 4 = 0 OR l_suppkey % 4 = 0) AS has_scripts, (l_partkey % 11 = 0 OR l_partkey % 7 = 0) AS has_large_ops,
    l_partkey % 13 = 0 AS has_brackets
  FROM regions_fx)"""

LINES = """
page_lines_fx AS (
  SELECT page_no, CAST(line_no AS INT) AS line_no, line_no * 20.0::DOUBLE AS line_y, 12.0::DOUBLE AS line_h
  FROM (SELECT DISTINCT l_orderkey AS page_no FROM lineitem WHERE l_orderkey % 3 <> 0), range(7) r(line_no))"""

RECOGNITIONS = REGIONS + """,
recognitions_fx AS (
  SELECT page_no, idx, id,
    CASE (page_no + idx) % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'pending' ELSE 'done' END AS status,
    CASE WHEN (page_no + idx) % 5 > 1 THEN concat('x_{', CAST(idx AS VARCHAR), '} = ', CAST(page_no AS VARCHAR)) END AS latex,
    (page_no * 31 + idx * 7) % 900 AS elapsed_ms,
    CASE WHEN (page_no + idx) % 5 = 0 THEN CASE WHEN page_no % 2 = 0 THEN 'timeout' ELSE 'invalid' END END AS error
  FROM regions_fx WHERE page_no % 4 <> 0)"""

TEXT_ITEMS = """
text_items_fx AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS line_no, str, 10.0::DOUBLE AS x, (i - 1) * 14.0::DOUBLE AS y,
    length(str) * 7.0::DOUBLE AS width, 12.0::DOUBLE AS height,
    CASE WHEN doc_id % 5 = 0 THEN 'Symbol' ELSE 'Times' END AS font, doc_id % 5 = 0 AS is_math_font
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS str,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE str <> '')"""

REPLIES = r"""
replies_fx AS (
  SELECT doc_id AS id, ['backend', 'zhipu', 'gemini', 'local'][CAST(doc_id % 4 + 1 AS INT)] AS provider, source,
    CASE doc_id % 8
      WHEN 0 THEN concat('```latex', chr(10), '\frac{a}{b} + ', CAST(doc_id AS VARCHAR), ' ', text, chr(10), '```')
      WHEN 1 THEN concat('$$x^2 + y^2 = ', CAST(doc_id AS VARCHAR), ' ', text, '$$')
      WHEN 2 THEN concat('text $\alpha_{i}$ ', text)
      WHEN 3 THEN concat('Sorry, the image is blurry ', text)
      WHEN 4 THEN concat('∫ f ≤ ∞ · π ', text)
      WHEN 5 THEN concat('\begin{matrix} a ', text)
      WHEN 6 THEN concat('{a_1}^{2 ', text)
      ELSE text END AS reply
  FROM documents)"""

HISTORY = """
history_fx AS (
  SELECT doc_id AS id, text AS latex,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 37 AS BIGINT)) AS created_at,
    CASE WHEN doc_id % 10 <> 0 THEN source END AS source, doc_id % 7 = 0 AS is_favorite
  FROM documents)"""

USERS = """
users_fx AS (
  SELECT user_id, concat('u', CAST(user_id % 140 AS VARCHAR), '@example.com') AS email, user_id % 2 = 0 AS email_verified,
    CASE WHEN user_id % 5 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS expires_at, user_id % 50 = 0 AS is_admin,
    CASE WHEN user_id % 100 = 0 THEN 'registered' ELSE 'none' END AS simulate_mode
  FROM (SELECT DISTINCT user_id FROM events))"""

REDEMPTIONS = """
redemptions_fx AS (
  SELECT event_id, ts, user_id,
    concat('ACTV-', lpad(CAST(event_id % 500 AS VARCHAR), 4, '0'), '-AAAA-AAAA') AS code,
    [5, 14, 40, 7][CAST(event_id % 4 + 1 AS INT)] AS amount
  FROM events WHERE event_type = 'purchase'),
plans_fx AS (SELECT * FROM (VALUES (5, 30), (14, 90), (40, 365)) t(amount, days)),
issued_fx AS (SELECT DISTINCT code FROM redemptions_fx WHERE substr(code, 9, 1) <> '9')"""

_CLOCK = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST((event_id % 20000) * 2 AS BIGINT))"
_EMAIL = "concat('u', CAST(user_id % 5 AS VARCHAR), '@example.com')"
SENDS = f"""
sends_fx AS (
  SELECT event_id, {_EMAIL} AS email, lpad(CAST(event_id * 7919 % 1000000 AS VARCHAR), 6, '0') AS code, {_CLOCK} AS ts
  FROM events WHERE event_type = 'signup')"""
ATTEMPTS = SENDS + f""",
tries_fx AS (SELECT event_id, {_EMAIL} AS email, {_CLOCK} AS ts FROM events WHERE event_type = 'click'),
attempts_fx AS (
  SELECT a.event_id, a.email, a.ts, CASE WHEN a.event_id % 3 <> 0 THEN coalesce((
    SELECT max_by(s.code, (s.ts, s.event_id)) FROM sends_fx s
    WHERE s.email = a.email AND (s.ts < a.ts OR (s.ts = a.ts AND s.event_id < a.event_id))), '000000')
    ELSE '000000' END AS code
  FROM tries_fx a)"""

STORE = """
store_fx AS (
  SELECT doc_id AS id, sha256(text) AS content_hash, concat('mc:0.6|res:', CAST(72 * (doc_id % 3 + 1) AS VARCHAR)) AS options_key,
    source AS owner, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 37 AS BIGINT)) AS ts, n_chars AS bytes
  FROM documents)"""

TILE_PAGES = """
tile_pages_fx AS (
  SELECT p_partkey AS page_id, CAST(800 + p_size * 60 AS BIGINT) AS width, 1000 + (p_partkey % 40) * 80 AS height FROM part)"""

RASTER = """
raster_fx AS (
  SELECT vec_id, CAST((i - 1) // 8 AS INT) AS row, CAST((i - 1) % 8 AS INT) AS col, v > 0 AS ink
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""

REVISIONS = """
revisions_fx AS (
  SELECT a.conv_id, a.turn, a.text AS original, b.text AS modified
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

"""Fixed schemas of stored tables."""

REGIONS = ("doc_id string, page_no bigint, id string, x double, y double, w double, h double, confidence double, "
           "kind string, latex string, markdown string")
TEXT_LAYER = ("doc_id string, page_no bigint, items array<struct<str: string, transform: array<double>, width: double, "
              "height: double, font: string>>, styles map<string, struct<family: string, is_math_font: boolean>>")
HISTORY = "id string, latex string, created_at timestamp, source string, is_favorite boolean"
RUN_METRICS = ("file string, ready boolean, elapsed_ms bigint, pages bigint, formulas bigint, type string, "
               "confidence double, per_page_ms double")
IMAGE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

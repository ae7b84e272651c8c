"""All named queries; importing the modules registers them."""

from . import (  # noqa: F401
    export_queries, metering_queries, raster_queries, region_queries, store_queries, stream_queries, text_queries)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""Imports every module that registers queries."""
from . import (  # noqa: F401
    composite_queries,
    io_queries,
    model_queries,
    raster_queries,
    score_queries,
    service_queries,
    shape_queries,
    spatial_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401

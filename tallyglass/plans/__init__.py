"""Every registered query; importing the package fills the registry."""

from . import (  # noqa: F401
    audit,
    billing,
    code,
    holes,
    monitoring,
    rollups,
    similarity,
    streams,
    texts,
    timeseries,
)
from .registry import ORACLES, QUERIES  # noqa: F401

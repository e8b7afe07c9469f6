"""Column-presence guard shared by all feature operators."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame

log = logging.getLogger("packetloom")


def has_columns(df: DataFrame, needed: Iterable[str], who: str, any_of: bool = False) -> bool:
    """True when the operator can run; otherwise warn, and the operator returns its input unchanged."""
    missing = [c for c in needed if c not in df.columns]
    if any_of:
        missing = missing if len(missing) == len(list(needed)) else []
    if missing:
        log.warning("%s skipped: missing columns %s", who, missing)
    return not missing

"""What counts as an anomaly."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and frames that mark a log line, and words that mark a cell or JSON value. Fixed values.
LOG_WORDS = ("error", "fail", "exception", "warn", "critical", "fatal", "traceback", r"caused\s+by")
LOG_FRAMES = (r"^\s+at\s+\w+\.", r'File\s+"[^"]+",\s+line\s+\d+')
VALUE_WORDS = ("error", "fail", "exception", "warn", "critical", "fatal")

LOG = "(?i:" + "|".join(LOG_WORDS) + ")|" + "|".join(f"(?:{x})" for x in LOG_FRAMES)
VALUE = "(?i)" + "|".join(VALUE_WORDS)


def log_anomaly(line: Column) -> Column:
    return line.rlike(LOG)


def value_anomaly(value: Column) -> Column:
    return F.coalesce(value.rlike(VALUE), F.lit(False))


def value_word(name: str) -> bool:
    """Whether a name is an anomaly, as known before any row is read."""
    return re.search(VALUE, name) is not None

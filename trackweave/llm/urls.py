"""Hosts and paths of URLs as columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.split(url, "://", 2)[1], r"^([^/?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.translate(host, string.ascii_uppercase, string.ascii_lowercase)).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(F.split(url, "://", 2)[1], r"^[^/?#]*([^?#]*)", 1)).otherwise("")

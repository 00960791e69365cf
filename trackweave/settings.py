"""Settings with typed defaults, read from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """The defaults of page sizes, limits and waits."""

    downloads_page: int = 500
    downloads_page_most: int = 1000
    jobs_page: int = 50
    jobs_page_most: int = 200
    items_page: int = 1000
    items_page_most: int = 5000
    max_concurrent_downloads: int = 1
    min_interval_seconds: float = 5.0
    backoff_seconds: int = 60
    max_retries: int = 5
    mp3_quality: str = "320k"
    cors_origins: str = "*"

    @classmethod
    def from_env(cls, prefix: str = "TRACKWEAVE_", environ: Mapping[str, str] = os.environ) -> Settings:
        """Values of the environment, or of the mapping given, in place of the defaults; what does not parse raises ValueError."""
        kinds = {"int": int, "float": float, "str": str}
        given = {f.name: environ[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in environ}
        return cls(**{f.name: kinds[str(f.type)](given[f.name]) for f in fields(cls) if f.name in given})

"""Settings of the pipeline, from the environment or from spark.conf under `storyloom.`."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 4000
    chunk_overlap: int = 400
    concurrency: int = 4
    retries: int = 1
    merge_threshold: float = 0.5
    lineage: bool = False
    own_candidates_only: bool = True  # a judge may pick only from a mention's own candidates
    chunk_lists: bool = True  # persons and relations carry the ids of their chunks; without, these are counted as rows only
    model: str = "rule"

    @classmethod
    def load(cls, spark: SparkSession | None = None) -> Settings:
        """Values of spark.conf go before those of the environment (STORYLOOM_CHUNK_SIZE and so on)."""
        found = {}
        for f in fields(cls):
            value = spark.conf.get(f"storyloom.{f.name}", None) if spark else None
            value = value if value is not None else os.environ.get(f"STORYLOOM_{f.name.upper()}")
            if value is not None:
                kind = type(f.default)
                found[f.name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
        out = cls(**found)
        if out.chunk_size < 1 or not 0 <= out.merge_threshold <= 1 or out.concurrency < 1:
            raise ValueError(f"settings out of range: {out}")
        return out

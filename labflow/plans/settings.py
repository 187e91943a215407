"""Settings of an analysis, read from the session's configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from labflow.operators.extraction import THRESHOLD, BlockClassifier


@dataclass(frozen=True)
class Settings:
    """labflow.extraction.enabled, labflow.extraction.threshold, labflow.extraction.client and labflow.semantics (parity or corrected)."""

    enabled: bool = False
    threshold: float = THRESHOLD
    client: str = "stub"
    corrected: bool = False


def settings(spark: SparkSession) -> Settings:
    """The session's settings; what it doesn't name is as by default."""
    get = lambda key, other: spark.conf.get(f"labflow.{key}", other)
    semantics = get("semantics", "parity")
    if semantics not in ("parity", "corrected"):
        raise ValueError("labflow.semantics has to be parity or corrected")
    return Settings(get("extraction.enabled", "false") == "true", float(get("extraction.threshold", str(THRESHOLD))), get("extraction.client", "stub"), semantics == "corrected")


#: Outside classifiers by name; a caller adds its own. The stub labels by rules alone.
CLIENTS: dict[str, Callable[[], BlockClassifier | None]] = {"stub": lambda: None}


def client(own: Settings) -> BlockClassifier | None:
    """The classifier that the settings name."""
    if own.client not in CLIENTS:
        raise ValueError(f"labflow.extraction.client has to be one of {', '.join(CLIENTS)}")
    return CLIENTS[own.client]()

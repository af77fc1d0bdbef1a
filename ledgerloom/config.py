"""Thresholds of the engine. Fixed values of the domain; results depend on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    confidence: float = 0.85
    discrepancy: float = 0.10
    critical_discrepancy: float = 0.30
    charge_deviation: float = 0.20
    income_deviation: float = 0.30
    similarity: float = 0.35
    top_k: int = 5
    chunk_size: int = 800
    chunk_overlap: int = 100
    max_file_bytes: int = 10 * 1024 * 1024


DEFAULTS = Thresholds()

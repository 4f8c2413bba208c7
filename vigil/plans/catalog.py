"""Imports every query module so the registry is complete."""

from __future__ import annotations

import importlib

from .registry import ORACLE, QUERIES

MODULES = ["q_grid", "q_shape", "q_features", "q_eval", "q_detect", "q_cluster", "q_classify", "q_experiment", "q_stream"]

for _m in MODULES:
    importlib.import_module(f"{__package__}.{_m}")

__all__ = ["QUERIES", "ORACLE"]

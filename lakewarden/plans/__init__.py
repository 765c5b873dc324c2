"""Named queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = ("q_scan", "q_redact", "q_policy", "q_catalog", "q_decide", "q_audit", "q_exchange", "q_stream")


def load():
    """``(queries, oracles)`` with every query module imported."""
    from lakewarden.plans import registry

    for module in MODULES:
        importlib.import_module(f"lakewarden.plans.{module}")
    return registry.QUERIES, registry.ORACLES

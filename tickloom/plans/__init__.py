"""Registered queries, one module per area."""

from __future__ import annotations

from importlib import import_module

MODULES = ["bars", "windows", "joins", "policy", "evaluation", "news", "signals", "files", "learning"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"tickloom.plans.{name}")

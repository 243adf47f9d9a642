"""Loggers of the engine: one line a step, to the console unless the application has set up logging itself."""

from __future__ import annotations

import logging

ROOT = "folioforge"


def get_logger(name: str = "") -> logging.Logger:
    """The logger of a part of the engine."""
    top = logging.getLogger(ROOT)
    if not top.handlers and not logging.getLogger().handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        top.addHandler(handler)
        top.propagate = False
        top.setLevel(logging.INFO)
    return top.getChild(name) if name else top

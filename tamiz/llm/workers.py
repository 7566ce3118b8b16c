"""Memory of Python workers: see ``tamiz.workers``."""

from __future__ import annotations

from tamiz.workers import frugal, release

__all__ = ["frugal", "release"]

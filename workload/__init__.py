"""Registered queries over the test tables, each with its SQL twin where SQL can say it."""

from . import checks, glossary, graphs, metrics, storage, text, usage  # noqa: F401
from .base import book

__all__ = ["book"]

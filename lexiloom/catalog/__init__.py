"""The registered queries over the provided tables and their SQL counterparts."""

from .registry import ORACLES, QUERIES
from . import evaluation, instances, learning, text, terms, vectors, vocabulary  # noqa: E402,F401

__all__ = ["ORACLES", "QUERIES"]

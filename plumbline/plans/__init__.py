"""Registered queries of the library's own operators."""

from . import analysis, building, judging, modelling, preparation  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

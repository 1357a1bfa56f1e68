"""Operators for preparing training data: one module per operator, each with its own query.

Nothing else in the library imports this subpackage. ``REGISTRY`` maps query names to callables
and ``ORACLE`` to DuckDB SQL where SQL can express the result; ``__spark_entry__`` adds both.
"""

from logsift.llm import queries as _queries
from logsift.llm.registry import ORACLE, REGISTRY

__all__ = ["ORACLE", "REGISTRY"]
del _queries

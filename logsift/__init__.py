"""logsift — build-log triage as Spark DataFrame operators.

Layout:
  functions/  Column -> Column expressions (redaction, masks, predicates, truncation)
  sources/    readers and writers (logs, requests, contributions, tables)
  operators/  DataFrame -> DataFrame operators (messages, templates, tracebacks, metrics, ...)
  plans/      reusable plan shapes (blocked scans, derived views, join helpers)
  streaming/  Structured Streaming versions of the metric and extraction operators
"""

from logsift.session import get_session  # noqa: F401

__all__ = ["get_session"]

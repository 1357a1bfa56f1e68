"""Query registrations, grouped by area. Importing this package fills ``logsift.catalog``."""

from logsift.queries import extraction  # noqa: F401
from logsift.queries import text  # noqa: F401
from logsift.queries import mining  # noqa: F401
from logsift.queries import analytics  # noqa: F401
from logsift.queries import corpus  # noqa: F401

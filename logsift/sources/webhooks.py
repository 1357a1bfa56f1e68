"""Webhook payload filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift import constants as C


def failed_build_events(hooks: DataFrame) -> DataFrame:
    """Job events worth analysing: an RPM build job (``^build.*rpm$``) that failed, of kind
    ``build``, from a merge-request pipeline."""
    return hooks.filter(F.col("build_name").rlike(C.BUILD_JOB_NAME_RE)
                        & (F.col("build_status") == "failed")
                        & (F.col("object_kind") == "build")
                        & (F.col("source") == "merge_request_event"))

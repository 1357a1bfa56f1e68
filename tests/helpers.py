"""Helpers shared by the test modules."""


def rows(df, *cols):
    """Collect ``cols`` as sorted tuples."""
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def lines_df(spark, text: str, artifact_id: int = 1, source_file: str | None = None):
    from logsift.operators.lines import split_lines
    d = spark.createDataFrame([(artifact_id, text, source_file)], "artifact_id long, text string, source_file string")
    return split_lines(d, "artifact_id", "text", keep=("source_file",))

"""Extractor options."""

from __future__ import annotations

import dataclasses

from logsift import constants as C


@dataclasses.dataclass(frozen=True)
class ExtractorOptions:
    """Options shared by the extractors: template LRU capacity, snippet cap, and which extra
    extractors run next to template mining."""

    max_clusters: int = C.DEFAULT_MAX_CLUSTERS
    max_snippet_len: int = C.DEFAULT_SNIPPET_LEN
    compiler_errors: bool = False
    python_traceback: bool = False

    def __post_init__(self):
        if self.max_snippet_len < C.MIN_SNIPPET_LEN:
            raise ValueError(f"max_snippet_len must be at least {C.MIN_SNIPPET_LEN}")
        if self.max_clusters < 1:
            raise ValueError("max_clusters must be positive")

    def extractors(self, rules=tuple(C.DEFAULT_NOISE_RULES), source_file: str | None = None):
        """The ``{name: lines -> snippets}`` map for ``extract_all``."""
        from logsift.operators.diagnostics import compiler_errors
        from logsift.operators.lines import assemble_messages
        from logsift.operators.noise import drop_noise
        from logsift.operators.templates import mine_templates, representative_snippets
        from logsift.operators.tracebacks import python_tracebacks

        keep = (source_file,) if source_file else ()

        def drain(lines):
            ch = drop_noise(assemble_messages(lines, self.max_snippet_len, keep=keep), rules, source_file=source_file)
            return representative_snippets(mine_templates(ch.drop(*keep)), self.max_clusters)

        out = {"drain": drain}
        if self.compiler_errors:
            def csgrep(lines):
                d = compiler_errors(lines, keep=keep)
                d = drop_noise(d, rules, source_file=source_file).select("artifact_id", "line_number", "text")
                return representative_snippets(mine_templates(d), self.max_clusters)
            out["csgrep"] = csgrep
        if self.python_traceback:
            out["python_traceback"] = lambda lines: python_tracebacks(
                lines, self.max_snippet_len, rules, keep=keep, source_file=source_file).drop(*keep)
        return out

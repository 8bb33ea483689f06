"""DuckDB statements the reports are checked against: plain SQL over the same parquet tables."""

from __future__ import annotations


def statements() -> dict[str, str]:
    from oracle import corpus, files, ingest, jobs, sheets, tree

    return {**corpus.SQL, **sheets.SQL, **tree.SQL, **ingest.SQL, **files.SQL, **jobs.SQL}

from .kpi import (
    KPI_COLUMNS,
    LABELLED_COLUMNS,
    MALFORMED,
    UNLABELLED_COLUMNS,
    LoadResult,
    load_both,
    load_test,
    load_train,
    parse_lines,
    paths_exist,
    to_series,
    typed,
)
from .logs import LogTables, load_logs
from .sinks import write_json_object, write_report, write_table

__all__ = [
    "KPI_COLUMNS",
    "LABELLED_COLUMNS",
    "MALFORMED",
    "UNLABELLED_COLUMNS",
    "LoadResult",
    "LogTables",
    "load_both",
    "load_logs",
    "load_test",
    "load_train",
    "parse_lines",
    "paths_exist",
    "to_series",
    "typed",
    "write_json_object",
    "write_report",
    "write_table",
]

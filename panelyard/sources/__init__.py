from panelyard.sources.readers import (
    drop_repeated_headers, joined_records, literal_table, numbered_lines, parse_lines, read_csv_checked, read_csv_skip, read_dim,
    read_table, skip_preamble,
)
from panelyard.sources.sinks import shared_path, store_panel, write_table

__all__ = [
    "drop_repeated_headers", "joined_records", "literal_table", "numbered_lines", "parse_lines", "read_csv_checked", "read_csv_skip",
    "read_dim", "read_table", "shared_path", "skip_preamble", "store_panel", "write_table",
]

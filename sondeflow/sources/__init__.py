"""Reading, writing and registering tables of readings."""

from .readers import accepted, read_clean_csv, read_clean_parquet, read_raw_csv, read_raw_lines, rejects
from .writers import register_view, save_table, write_clean_csv, write_clean_parquet

__all__ = [
    "accepted", "read_clean_csv", "read_clean_parquet", "read_raw_csv", "read_raw_lines",
    "register_view", "rejects", "save_table", "write_clean_csv", "write_clean_parquet",
]

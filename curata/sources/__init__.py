"""Sources and sinks: CSV / JSON / parquet readers, type normalisation,
CSV writers, preview. Everything goes through ``spark.read`` / ``df.write``."""

from .readers import (NA_TOKENS, load_table, normalize_types, number_rows, preview, read_csv,
                      read_json, read_parquet, read_sample, write_csv, write_csv_file, write_json_array)
from .derived import dirty_orders, table

__all__ = ["NA_TOKENS", "load_table", "normalize_types", "number_rows", "preview", "read_csv", "read_json",
           "read_parquet", "read_sample", "write_csv", "write_csv_file", "write_json_array", "dirty_orders", "table"]

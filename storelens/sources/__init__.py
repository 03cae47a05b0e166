"""Readers, writers and the fixture views over the driver tables."""

from storelens.sources.io import (load_rfm, read_parts, read_table, require_columns,
                                  segments_json, synth_rfm, write_csv, write_outputs)

__all__ = ["read_table", "read_parts", "require_columns", "load_rfm", "write_outputs",
           "segments_json", "write_csv", "synth_rfm"]

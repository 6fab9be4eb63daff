"""Tables and record files."""

from sluice.sources.records import close_records, open_records, read_batch, read_record, table, write_records

__all__ = ["close_records", "open_records", "read_batch", "read_record", "table", "write_records"]

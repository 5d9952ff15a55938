"""Readers and writers."""

from vetta.sources.readers import (  # noqa: F401
    read_csv, read_json_lines, read_label_batches, read_labeled_lines, read_requests,
    read_samples_json,
)
from vetta.sources.writers import (  # noqa: F401
    write_label_batches, write_labeled_lines, write_metrics, write_table,
)

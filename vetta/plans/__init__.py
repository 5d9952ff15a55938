"""Composite jobs, the mapping of the shared test tables onto review roles, and the
query catalog used by ``__spark_entry__``."""

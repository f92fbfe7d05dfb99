"""Independent SQL for checking query results."""

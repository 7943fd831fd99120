"""Parser programs: raw log messages to events."""

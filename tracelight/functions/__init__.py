"""Column builders: the event schema, field paths and conditions."""

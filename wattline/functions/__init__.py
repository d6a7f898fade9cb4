"""Column expressions (no jobs): time parsing, calendar, labels, colours."""

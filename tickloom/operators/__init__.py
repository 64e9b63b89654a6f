"""Range filters, aggregates, windows, range joins and keyed writes."""

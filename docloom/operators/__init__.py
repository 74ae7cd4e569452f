"""DataFrame operators: records, joins, aggregates, vocabularies, splits, metrics and pages."""

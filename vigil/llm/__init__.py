"""Training-data operators: dedup, language, scoring, packing, filters, joins."""

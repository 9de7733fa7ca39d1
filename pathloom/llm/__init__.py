"""Training-data operators: mixing, language ID, URL filters, joins, quality, search, packing, archives, media, PII."""

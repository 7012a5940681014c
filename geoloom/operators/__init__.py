"""DataFrame operators: filters, joins, aggregations, windows, raster, network, quality checks."""

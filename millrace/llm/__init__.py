"""Operators of a training-data pipeline: packing, cleaning, filters, joins and archives."""

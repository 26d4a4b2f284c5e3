"""Training-data operators: corpus filters, joins, encoders and archive writers.

Nothing outside this subpackage imports it.
"""

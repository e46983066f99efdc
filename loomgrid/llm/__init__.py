"""Training-data operators: deduplication, joins, scoring, filters and encoders.

Nothing outside this package imports it; ``queries`` registers its queries.
"""

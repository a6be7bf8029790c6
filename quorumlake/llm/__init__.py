"""Training-data operators: packing, toxicity, language ID, joins, dedup, filters, scans, sketches.

Self-contained: nothing outside this subpackage imports it, and it imports
nothing from the rest of the library.
"""

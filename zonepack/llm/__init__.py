"""Training-data operators: ten distributed text and vector jobs.

Nothing else in the library imports this subpackage.
"""

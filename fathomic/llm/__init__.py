"""Training-data operators: ten methods over documents and pages.

Nothing else in the library imports this subpackage.
"""

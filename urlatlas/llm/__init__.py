"""Training-data operators: ten operators over documents and pages, and their registered queries.

Nothing else in the library imports this subpackage.
"""

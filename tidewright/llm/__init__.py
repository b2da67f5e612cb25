"""Training-data operators, one module each.

Nothing else in the library imports this subpackage. The registered queries
are in :mod:`tidewright.llm.queries`.
"""

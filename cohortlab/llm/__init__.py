"""Operators for preparing large text corpora (deduplication, filtering, encoding, packing, archives).

Nothing else in the library imports this subpackage; it may be removed as a whole.
``cohortlab.llm.queries`` names the registered queries and their SQL.
"""

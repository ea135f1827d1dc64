"""Registered queries of the document operators, with their SQL."""

"""Operators on the tables of decoded documents."""

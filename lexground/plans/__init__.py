"""Registered queries: every operator bound to views of the given tables, with the same query in SQL."""

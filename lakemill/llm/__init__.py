"""Operators on documents in tokens, and batch de-duplication by suffix arrays. Nothing else in lakemill imports this."""

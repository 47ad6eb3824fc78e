"""Relational operators on chains, scores and generations."""

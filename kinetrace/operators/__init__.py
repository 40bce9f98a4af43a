"""Observables, event extraction, temporal relations, analytics."""

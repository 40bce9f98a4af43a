"""Topologies, trajectory readers, adapters."""

"""Quantities, atom selections, geometry kernels."""

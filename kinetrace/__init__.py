"""Temporal event analytics over molecular trajectories on Spark.

The names below are imported when first used, so that executors load only what they need.
"""

from importlib import import_module

_PLACES = {
    "EventResults": ".plans.results",
    "QueryError": ".plans.language",
    "Topology": ".sources.topology",
    "Trajectory": ".plans.api",
    "distance": ".functions.kernels",
    "explain": ".plans.planner",
    "explain_query": ".plans.planner",
    "load": ".plans.api",
    "minimum_image_distance": ".functions.kernels",
    "minimum_image_distance_cell": ".functions.kernels",
    "optional_backend_available": ".sources.readers",
    "parse_duration_ps": ".functions.units",
    "parse_query": ".plans.language",
    "supported_trajectory_extensions": ".sources.readers",
    "validate": ".plans.planner",
}
__all__ = list(_PLACES)


def __getattr__(name: str):
    if name in _PLACES:
        return getattr(import_module(_PLACES[name], __name__), name)
    raise AttributeError(name)

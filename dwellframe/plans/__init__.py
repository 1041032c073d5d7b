"""Registered queries: each pairs a DataFrame with an independent SQL twin."""

from dwellframe.plans import registry

_MODULES = (
    "statistics", "search", "cleaning", "enrichment", "increment", "webpages",
    "features", "mining", "synthesis", "streams", "modelling",
)


def load_all():
    import importlib
    for name in _MODULES:
        importlib.import_module(f"dwellframe.plans.{name}")
    return registry.REGISTRY

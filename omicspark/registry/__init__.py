"""All registered queries."""

from importlib import import_module

MODULES = ("views", "preparation", "proteins", "quality", "reads", "enrichment", "sites")


def load():
    from omicspark.registry import base

    for name in MODULES:
        import_module(f"omicspark.registry.{name}")
    return base.QUERIES

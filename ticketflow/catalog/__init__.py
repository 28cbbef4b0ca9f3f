"""Queries over the given tables, with equivalent SQL where there is one."""

from importlib import import_module

MODULES = ("cleaning", "gold", "monitoring", "vectors", "scoring", "streams", "models")


def load():
    from . import registry
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLES

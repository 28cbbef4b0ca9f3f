"""Operators for training data: deduplication, tokenizing, selection, packing, formatting, privacy.

Nothing outside this folder imports it. ``load`` returns its registered queries and their SQL.
"""

from importlib import import_module

MODULES = ("suffixes", "pieces", "quality", "fingerprints", "bestfit", "chat", "privacy", "simhash", "embeddings",
           "binpack", "search", "licenses", "whitening")


def load():
    """Queries and SQL texts of all operators here, by name."""
    from . import registry
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLES

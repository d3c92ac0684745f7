"""Analysis of typed Markdown corpora, on Spark."""

__version__ = "0.2.0"

_EXPORTS = {"Bundle": "scriptorium.plans.bundle", "load": "scriptorium.plans.law", "LawRefused": "scriptorium.plans.law", "parse": "scriptorium.sources.markdown", "main": "scriptorium.plans.cli", "write": "scriptorium.plans.writing"}
__all__ = list(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    import importlib

    return getattr(importlib.import_module(_EXPORTS[name]), name)

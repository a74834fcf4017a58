"""Analytics of change histories on Spark: who changed what, when, and what is left of it."""

_PLACES = {"History": ".plans.session", "Operator": ".plans.registry", "Option": ".plans.registry", "Registry": ".plans.registry", "registry": ".plans.registry"}
__all__ = list(_PLACES)


def __getattr__(name: str):
    """Loads what is asked for only then, so that Python workers which need one kernel don't load the rest."""
    from importlib import import_module

    if name in _PLACES:
        import_module(".plans.session", __name__)  # registers the operators
        return getattr(import_module(_PLACES[name], __name__), name)
    raise AttributeError(name)

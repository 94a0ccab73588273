from tabstat.catalog import registry

_loaded = False


def load() -> None:
    """Import every catalog module once so that its queries register."""
    global _loaded
    if not _loaded:
        import importlib
        import pkgutil
        for m in pkgutil.iter_modules(__path__):
            importlib.import_module(f"{__name__}.{m.name}")
        _loaded = True


def queries():
    load()
    return dict(registry.QUERIES)


def oracle_sql():
    load()
    return dict(registry.ORACLES)

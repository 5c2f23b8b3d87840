"""Named queries over the supplied tables."""


def load_catalog():
    """(queries, reference SQL), after importing every module that registers queries."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"framelake.plans.{module}")
    from framelake.plans.catalog import ORACLES, QUERIES

    return QUERIES, ORACLES


MODULES = ("raster", "timelines", "records", "contracts", "production", "intake")

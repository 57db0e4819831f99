"""Query plans over the driver's tables; importing the modules fills the catalogue."""

import importlib
import pkgutil


def load_catalogue() -> tuple[dict, dict]:
    """Import every plan module and return (queries, oracle SQL) by name."""
    from fieldloom.plans import catalogue

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return catalogue.QUERIES, catalogue.ORACLES

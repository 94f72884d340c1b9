"""Registered queries. Importing this package fills the registry."""

from importlib import import_module

for _name in ("library", "sources", "cleaning", "marts", "joining", "quality", "series", "folds", "forecasts", "evaluation", "serving", "statistics", "models"):
    import_module(f"stockloom.plans.{_name}")


def flagship(spark, path):
    from stockloom.plans.series import flagship as build
    from stockloom.sources.adapters import Source

    return build(Source(spark, path))

"""Registered queries by operator family."""

from importlib import import_module

FAMILIES = ["scans", "projections", "calendars", "joins", "aggregates", "windows", "sequences", "selections", "statistics", "models", "streams"]


def load_all():
    for f in FAMILIES:
        import_module(f"{__name__}.{f}")

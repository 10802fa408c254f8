"""Registered queries, grouped by topic."""

from importlib import import_module

TOPICS = ("form", "columns", "lookups", "feeds", "betting", "evaluation", "learning", "streams", "features")


def load_all() -> None:
    for topic in TOPICS:
        import_module(f"tallyline.plans.{topic}")

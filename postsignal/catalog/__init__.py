"""Queries over the given tables, one per operator, each with an SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

AREAS = ("text", "scoring", "capture", "media", "storage", "ranking", "similarity", "streams", "trends", "models")


def _areas():
    return [import_module(f"postsignal.catalog.{name}") for name in AREAS]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for area in _areas() for name, query in area.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for area in _areas() for name, sql in area.SQL.items()}

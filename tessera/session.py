"""Sessions with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", **conf: str) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive execution; ``conf`` adds to or overrides that (dots as ``__``)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()

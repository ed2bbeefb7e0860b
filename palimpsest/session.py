"""A session with the settings that the library's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "palimpsest", master: str | None = None, **conf) -> SparkSession:
    build = SparkSession.builder.appName(name)
    if master:
        build = build.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        build = build.config(key, value)
    return build.getOrCreate()

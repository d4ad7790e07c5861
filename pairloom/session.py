"""Session builder with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings the operators rely on for their semantics (not for speed).
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: Settings that let the optimiser re-plan at run time.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "pairloom", **conf: str) -> SparkSession:
    """A session with SEMANTIC_CONF and PLAN_CONF; keyword arguments use ``_`` for ``.``."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (SEMANTIC_CONF | PLAN_CONF).items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()

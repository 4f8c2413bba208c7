"""Session helpers.

Every operator in the library works on whatever ``SparkSession`` it is handed.
The only session-level requirement is a UTC session time zone, because the
time arithmetic converts ``timestamp_ntz`` wall-clock values to epoch
microseconds through ``TIMESTAMP``; under UTC that conversion is the identity.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on; applied by ``ensure_session``.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Sensible defaults for a fresh session (tests, bench). A cluster submit sets
# its own values; ``build_session`` never overrides what is already set.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Broadcast only tables Spark has sized below 32 MB; everything we
    # broadcast explicitly is a bounded model table (see operators/*).
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vigil`` importable in the Python workers (pandas UDFs and
    grouped-map functions are pickled by module reference). A submit that
    already lists the package in ``spark.submit.pyFiles`` needs nothing;
    otherwise (local sessions, notebooks) the package is zipped once per
    SparkContext on the driver and registered with ``addPyFile``, which
    distributes it to every executor. No data goes through that folder."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    # a cluster submit ships the package itself (--py-files / spark.submit.pyFiles)
    if "vigil" in (spark.conf.get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(key)
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="vigil-pkg-"), "vigil.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_session(spark: SparkSession) -> SparkSession:
    """Apply the settings the library needs to an existing session."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "vigil", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    Only used by tests and ``bench.py``; production code receives a session.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf.update(REQUIRED_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_session(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session. Where it is unset, a local
    session (tests) gets a fresh scratch folder; on a cluster that is an error,
    because executors could not share it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="vigil-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)

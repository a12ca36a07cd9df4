"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "auditspark") -> SparkSession:
    """Session tuned for the operators in this package.

    AQE stays on so joins against dimension tables turn into broadcasts only
    when their measured size is under ``autoBroadcastJoinThreshold`` and skewed
    shuffle partitions are split at run time.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    memory = os.environ.get("AUDITSPARK_DRIVER_MEMORY")
    if not memory and master.startswith("local"):
        # The driver is the only worker here: half of the machine, 16 GB at most.
        gb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2 ** 30
        memory = f"{max(1, min(16, int(gb / 2)))}g"
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if shuffle_partitions or master.startswith("local"):
        # One shuffle partition per local core; on a cluster the cluster's own
        # setting (sized to the data) is kept.
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    if master.startswith("local"):
        # A long local session runs many queries in one JVM: a frequent driver
        # GC lets Spark's cleaner drop the shuffle files, broadcasts and
        # checkpoints of finished queries instead of letting them pile up.
        builder = (builder.config("spark.cleaner.periodicGC.interval", "30s")
                   .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only in local mode.

    On a cluster ``spark.checkpoint.dir`` must name a shared file system folder;
    a machine-local temporary folder would lose checkpoints with the executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="auditspark-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()

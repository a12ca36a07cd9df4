"""auditspark: audit-data cleaning, brand resolution and share statistics on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, so it composes with ``df.transform`` and runs unchanged from
``local[*]`` to a cluster.
"""

from auditspark.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]

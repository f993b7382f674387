"""retailcast: retail demand-forecasting features and hybrid forecasters on Spark.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and
builds a lazy logical plan; actions happen only in sinks, model fits and
scoring.
"""

from retailcast.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]

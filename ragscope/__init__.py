"""ragscope: score, summarise and compare question/answer samples on Spark.

Every operator takes and returns DataFrames or Columns; nothing collects
per-sample rows to the driver.
"""

from ragscope.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"

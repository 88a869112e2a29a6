"""Posting analytics as Spark DataFrame operators.

Every operator is ``fn(df, ...) -> DataFrame`` (or ``Column -> Column``), lazy,
and without hidden state.
"""

from postlens.session import checkpoint_dir, clear_scratch, scratch_path, spark_session, written

__all__ = ["checkpoint_dir", "clear_scratch", "scratch_path", "spark_session", "written"]

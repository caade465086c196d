"""colloquy: dialogue analytics as Spark DataFrame jobs.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and
is expressed with built-in column functions wherever possible, so Catalyst can
prune, push down and fuse it into whole-stage code generation.
"""

from colloquy.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]

"""cohortlens — population risk screening as composable Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function (or returns a small
report DataFrame).  Nothing collects rows to the driver except bounded
aggregates such as quantile edges, category totals or anchor lists.
"""

from cohortlens.session import get_spark, checkpoint_dir, cut_lineage

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage"]

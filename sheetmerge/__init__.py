"""sheetmerge: template-driven merging of many similar tables on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# The few Python tasks (xlsx parse, fixture writers) are shipped by value, so
# executors need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from sheetmerge.plans.job import MergePlan, MergeResult, detect_anomalies, merge_tables  # noqa: E402

__all__ = ["MergePlan", "MergeResult", "detect_anomalies", "merge_tables"]

"""Listing consolidation on Spark: read feeds, upsert, score, resolve, report.

Every operator takes and returns DataFrames.  The few Arrow functions of the
package are pickled by value, so executors do not need it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

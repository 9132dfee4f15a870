"""marlstone: text and experiment analytics written as Spark DataFrame jobs.

* ``functions``  Column in, Column out (row-wise, no shuffle)
* ``operators``  DataFrame in, DataFrame out (joins, grouping, models)
* ``sources``    readers and writers
* ``streaming``  Structured Streaming queries
* ``plans``      end-to-end plans and the query catalogue
"""

import sys

from pyspark import cloudpickle

from .session import get_session, shared_dir

# Helpers used inside tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "shared_dir"]

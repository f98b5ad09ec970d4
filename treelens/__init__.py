"""Per-directory knowledge from large corpora of source files, as Spark jobs.

Every operator is a plain function from DataFrame (or Column) to DataFrame (or
Column); `treelens.plans` strings them together into whole runs.
"""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the job, so the
# executors do not need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

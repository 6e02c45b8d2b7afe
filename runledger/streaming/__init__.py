"""Structured Streaming forms of the run-state rules."""

import sys

from pyspark import cloudpickle

# The few Python functions of this package travel with the plan, so workers need no install of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

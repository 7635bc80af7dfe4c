"""hostwatch: network-flow, session and host-behaviour analytics on Spark.

Every public function takes and returns Spark DataFrames (or Columns).  Layout:

* ``functions``  column expressions
* ``operators``  DataFrame transformations
* ``sources``    readers, sinks and table adapters
* ``plans``      end-to-end jobs built from the above
* ``streaming``  Structured Streaming forms of sessionising and host baselines
* ``catalog``    the named queries that ``__spark_entry__`` registers
"""

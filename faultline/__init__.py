"""faultline — structural-health analytics for source trees, as Spark jobs.

Layout:
  functions/  Column -> Column expressions (text metrics, paths, display)
  operators/  DataFrame -> DataFrame operators (graph, history, scoring, ...)
  sources/    readers and writers, plus the driver-table bindings
  plans/      composite jobs (scan report, baseline, drift, gate) and the
              query catalog used by __spark_entry__.py and bench.py
  streaming/  the streaming gate over arriving changed files
"""

__version__ = "0.1.0"

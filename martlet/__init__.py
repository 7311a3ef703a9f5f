"""martlet — shop behaviour and sales analytics as Spark DataFrame operators.

Layout:
  sources/    file readers, row cap, fixture mapping of the supplied tables
  functions/  Column builders (dates/periods, safe casts, segment rule, joins)
  operators/  cleaning, facts, funnels, cohorts, RFM/KMeans, sales queries,
              data quality, log profiling, ad-hoc SQL
  plans/      the batch pipeline and the dashboard bundle
  sinks/      staged multi-table publish, DQ log append
  streaming/  incremental ingest of the behaviour log
"""

__version__ = "0.1.0"

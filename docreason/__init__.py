"""Document-reasoning analytics on Spark.

Sub-packages:
  functions  -- Column-level helpers (score coercion, JSON checks, ranks' maths)
  operators  -- DataFrame operators (metrics, ranks, paired tests, bootstrap,
                blocks, requests/responses, question/answer jobs)
  sources    -- readers and writers (JSON arrays/lines, CSV, binary files, ledger)
  streaming  -- incremental ingest and resume jobs
  plans      -- derived views over the driver tables and the registered queries
"""

__version__ = "0.1.0"

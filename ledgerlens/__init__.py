"""ledgerlens: ledger variance analytics as Spark DataFrame operators.

Modules:
  operators  -- validation, balances and variance, detection, history,
                costs and call rates, result reuse, documents and search,
                explanations and reports, distributed ranking
  functions  -- column expressions for text repair/masking and time
  sources    -- file sources and sinks, synthetic ledgers
  plans      -- stored tables, the whole-analysis chain, registered queries
  streaming  -- Structured Streaming loads
"""

__version__ = "0.1.0"

"""marketspark: marketplace analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames to DataFrames. Batch and
streaming share the same code; `plans` wires operators to the test
tables, `sources` loads and adapts inputs, `functions` holds Column
helpers, `streaming` holds the Structured Streaming forms.
"""

__version__ = "0.1.0"

"""rivulet: market-data and document-retrieval operators on Spark DataFrames.

Every operator is a function ``DataFrame(s) -> DataFrame`` with no action
inside; batch jobs, streaming ``foreachBatch`` bodies and the query catalog in
``rivulet.plans`` all call the same functions.
"""

__version__ = "0.1.0"

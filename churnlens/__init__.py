"""churnlens: customer-retention analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame. Sub-packages:

* ``sources``   -- readers, writers and the mapping of the test tables to the domain
* ``functions`` -- shared column helpers, the distributed global rank / prefix sum,
                   special functions for p-values
* ``operators`` -- the analytic operators grouped by topic
* ``plans``     -- compositions of operators and the registered query catalog
* ``streaming`` -- Structured Streaming scoring and throughput
"""

__version__ = "0.1.0"

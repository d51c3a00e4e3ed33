"""carelens: Spark-native analytics for social-media health posts.

Every operator is a function ``DataFrame -> DataFrame`` (or a Column builder)
written with the DataFrame API, so Catalyst plans it and it runs distributed.

Sub-packages:

* ``sources``   - readers, stand-in views over the driver tables, sinks, paging
* ``functions`` - Column builders: text cleaning, hashing, regex helpers, fixed word lists
* ``operators`` - filters, de-identification, joins, matching, normalization, reports
* ``plans``     - pass chains and the query registry used by ``__spark_entry__``
* ``streaming`` - Structured Streaming versions of the cleaning chain and de-duplication
"""

__version__ = "0.1.0"

"""larder: inventory and procurement analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames to DataFrames.  Subpackages:

* ``sources``   - table schemas, the inventory model over raw tables, request
                  batches, sinks and view registration
* ``functions`` - small column-expression helpers shared by the operators
* ``operators`` - views, listings, ledger folds, guard, audit, orders,
                  catalog writes and integrity reports
* ``streaming`` - Structured Streaming versions of the ledger operators
* ``plans``     - named queries over a data directory (used by the driver
                  entry point and the benchmark)
"""

from larder.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]

"""storelens: retail and customer analytics as Spark DataFrame operators.

Every public operator takes a DataFrame (plus small arguments) and returns a
DataFrame.  Sub-packages:

* ``sources``   - readers, writers and the fixture views over the driver tables
* ``functions`` - column-expression helpers and shared distributed building
                  blocks (exact quantiles, checked broadcast, lineage cuts)
* ``operators`` - the analytics themselves (cleaning, RFM, cohorts, stores,
                  profiles, clustering, segments, pricing rules, scoring)
* ``plans``     - the registered queries and their SQL oracles
* ``streaming`` - Structured Streaming form of the incremental aggregates
"""

__version__ = "0.1.0"

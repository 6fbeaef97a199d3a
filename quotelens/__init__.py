"""quotelens: Spark-native quotation pricing analytics.

Main entry points (see README.md for the full map):

* ``sources.readers.read_quotes`` and ``operators.cleaning.clean_quotes``
* ``operators.reports`` (historical reports A1-A15)
* ``operators.pricing`` (scenario pricing, margin grid, recommendations, flags)
* ``operators.model`` / ``operators.evaluation`` (win model and holdout metrics)
* ``plans.scorecard.Scorecard`` (a fixed scorer); fitted models score the same way
"""

__version__ = "0.1.0"

"""papyrus: bibliographic analytics as Spark DataFrame plans.

Operators live in :mod:`papyrus.operators` (graphs, ranking, communities,
reports, lookups, text, vectors) and take and return DataFrames; inputs
come from :mod:`papyrus.sources`; :mod:`papyrus.plans` registers the
queries the driver runs and their DuckDB twins.
"""

__version__ = "0.1.0"

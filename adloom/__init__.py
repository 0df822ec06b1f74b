"""adloom: a Spark-native marketing ETL and analytics engine.

Ingest marketing tables, validate and profile them, clean them, derive funnel,
temporal, ranking and anomaly features, and answer a fixed family of reports.
Everything is expressed with DataFrame / Spark SQL built-ins.
"""

from adloom.session import get_spark, materialize  # noqa: F401
from adloom.plans.pipeline import CleanOptions, clean_dataset  # noqa: F401

__all__ = ["get_spark", "materialize", "CleanOptions", "clean_dataset"]

"""ledgerscope: transaction anomaly analytics expressed as Spark DataFrame plans.

Three detection families run on Spark DataFrames:

* ``operators.rules``      six explainable per-user rules and a composite score
* ``operators.supervised`` engineered features + gradient-boosted trees
* ``operators.ensemble``   label-free isolation forest / DBSCAN noise / LOF vote

Everything is lazy: functions take and return DataFrames; only models,
scalars and small reports reach the driver.
"""

from ledgerscope.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

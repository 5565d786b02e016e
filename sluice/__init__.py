"""sluice — Spark-native event admission, delivery and audit jobs.

Every operator is a function ``DataFrame -> DataFrame`` (thresholds are
arguments).  Nothing is collected to the driver: global cuts are expressed as
scalar subqueries so the whole job stays one Catalyst plan.
"""

from sluice.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

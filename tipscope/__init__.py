"""tipscope: trip-fare and tipping analytics plus chunk retrieval on Spark.

Every public function takes and returns a ``DataFrame``; the work is
expressed with built-in Spark SQL operators so Catalyst can prune, push
down and plan the shuffles.
"""

from tipscope.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

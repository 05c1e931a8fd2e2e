"""frostline: frozen-context prediction-market analytics on Spark.

Daily reconcile of event/market snapshots, stratified sampling, and
context-report assembly (search dedup, paragraph extraction, TF-IDF
ranking, prompt and report text), expressed as DataFrame / Spark SQL jobs.
"""

from frostline.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

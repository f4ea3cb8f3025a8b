"""vqaframe: multimodal question-answering data preparation and evaluation on Spark.

Every public function takes and returns DataFrames; nothing is collected to the
driver except bounded summaries (histograms, per-partition counts, vocabulary
sizes) that pick a plan.
"""

from vqaframe.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]

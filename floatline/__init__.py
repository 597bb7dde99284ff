"""floatline: a Spark-native tracker of new stock listings.

Landed calendar / submission JSON and prospectus HTML become five tables
(issuers, filings, offerings, capitalization, lockups) and three date-window
reports.  Every step is a DataFrame transformation built from Spark's own
functions, so Catalyst plans it and the cluster runs it.
"""

from floatline.session import ensure_checkpoint_dir, get_spark

__all__ = ["ensure_checkpoint_dir", "get_spark"]

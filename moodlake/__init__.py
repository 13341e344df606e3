"""moodlake — engagement-weighted sentiment analytics over text posts, built on Spark.

Every public function takes DataFrames (and explicit parameters such as ``as_of``)
and returns a DataFrame. The driver only ever receives bounded results:
size-checked dictionaries and query blocks, single query vectors, one-row
aggregates (counts, ranges, sketches) and the small final window of the exact
quantile selection.
"""

from moodlake.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]

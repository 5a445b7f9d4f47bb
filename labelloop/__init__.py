"""labelloop: LLM/SLM collaborative labelling as Spark DataFrame jobs.

Every operator takes and returns DataFrames. Sub-packages:

* ``sources``   - scans and sinks (CSV ingest, Parquet stage tables, feedback, vocabulary)
* ``functions`` - column expressions (vector maths, text normalisation, label parsing)
* ``operators`` - relational operators (kNN retrieval, selection, clustering, training rows)
* ``plans``     - end-to-end jobs (labelling rounds, self-training, outer loop) and the query catalogue
* ``streaming`` - Structured Streaming forms of the labelling round
"""

from labelloop.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]

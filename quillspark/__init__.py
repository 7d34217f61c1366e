"""quillspark: invoice lakehouse analytics as Spark DataFrame / SQL / Structured Streaming jobs.

Layers: raw -> bronze (metadata + row fingerprint) -> silver (dedup, repair, derive)
-> gold (vendor / month / category summaries), plus declarative quality checks,
a feature table, a distributed isolation forest, text documents with overlapping
chunks and filtered cosine top-k retrieval.
"""

from quillspark.config import RunConfig
from quillspark.session import build_session, checkpoint_dir

__all__ = ["RunConfig", "build_session", "checkpoint_dir"]

# Functions that run in Python workers (forest fit/score, top-k, embedding helpers) are shipped
# with their code: workers need no installed copy of this package (no --py-files on a cluster).
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without by-value support
    pass

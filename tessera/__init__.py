"""tessera — messy-table unification on Spark.

Many inconsistent tabular exports become one queryable table: lenient all-text
scans, sheet-grid cleaning, a schema catalog (fingerprints, column alignment,
mapping memory, drift), the canonical union, seven typed transformation steps
and guarded read-only queries. Every operator is a DataFrame -> DataFrame
function built from native Spark expressions.
"""

from tessera.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]

"""urlatlas: URL-harvest analytics on Spark.

Column functions (``urlatlas.functions``), DataFrame operators
(``urlatlas.operators``), sources, whole plans and streaming forms; see the
README for the operator map.
"""

__version__ = "0.1.0"

"""knotwork: graph connectivity as declarative PySpark plans."""

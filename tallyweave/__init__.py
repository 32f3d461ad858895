"""Record linkage and corpus operators, written for PySpark."""

"""marlstone: building, selecting and auditing decision datasets with PySpark."""

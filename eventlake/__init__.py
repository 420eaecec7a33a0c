"""Event-log analytics on PySpark: a structured query algebra, reads, writes, integrity checks and streams over tables of log records."""

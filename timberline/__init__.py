"""Log analytics on Spark: raw log files in, a typed ``logs`` table out."""

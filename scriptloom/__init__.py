"""Script-corpus analytics on Spark: scan, classify, register, translate, trace."""

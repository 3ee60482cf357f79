"""Document-corpus analytics on Spark: catalogue queries, text mining, rule engines and staged upserts."""

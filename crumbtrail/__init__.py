"""Opinion mining over reviews as Spark plans: ingest, select, profile, rank, trim."""

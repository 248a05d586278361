"""Tables with changes, kept as Parquet snapshots."""

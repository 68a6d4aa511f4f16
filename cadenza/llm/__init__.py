"""Training-data pipeline operators: dedup, scans, scoring, mixing, packing, media, chat."""

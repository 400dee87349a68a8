"""Per-stratum slicing and packaging of related tables on Spark."""

"""Writers: year-partitioned bars, reports and committed snapshots."""

"""Construction takeoff data as Spark jobs: layout recovery, reconciliation,
correction overlays, price books, merges and feeds."""

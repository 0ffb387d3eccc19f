"""Claims reconciliation as Spark jobs: DataFrame operators over many scans at once."""

"""Bill reading, draft lifecycle and ledger analytics as ordinary Spark jobs."""

"""Message intake and the draft life cycle as Structured Streaming jobs."""

"""Reading messages, labels and ledgers; writing extracts and reports."""

"""Writers: run outputs, append-only logs, keyed upserts."""

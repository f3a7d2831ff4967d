"""The append-only fetch log as a stream."""

"""The job queue as a stream."""

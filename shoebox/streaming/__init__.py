"""Change events as a stream."""

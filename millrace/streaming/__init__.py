"""Change feeds and idempotent appends, in batch and as streams."""

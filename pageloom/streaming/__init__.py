"""Jobs, progress and their state, as batch and as streams."""

"""Current state kept up to date from event streams."""

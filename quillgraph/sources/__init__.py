"""Where notes come from and where snapshots go."""

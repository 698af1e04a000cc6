"""Where pages come from, how they become element rows, and where results go."""

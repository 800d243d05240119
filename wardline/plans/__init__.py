"""Named queries composed from the operators, and their oracle SQL."""

"""Where points come from and where results go."""

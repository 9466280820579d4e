"""Where tables come from and where they go."""

"""Where records come from and where tables go."""

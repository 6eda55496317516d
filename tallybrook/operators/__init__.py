"""Pure DataFrame-to-DataFrame transformations."""

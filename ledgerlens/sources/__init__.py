"""What comes in, and the store that keeps it."""

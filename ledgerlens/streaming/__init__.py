"""The stream of writes and the work that it owes."""

"""Functions over columns and texts, and what differs between two dialects of SQL."""

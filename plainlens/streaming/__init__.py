"""Optional extension: the batch operators on arriving files."""

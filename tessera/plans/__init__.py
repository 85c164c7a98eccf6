"""Physical pair and iteration plans."""

"""Reading trees of text files."""

"""Column-level building blocks: vectors, text, dates and rendering."""

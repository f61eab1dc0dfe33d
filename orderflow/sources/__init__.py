"""Reading order tables, words, pages and profiles; writing results."""

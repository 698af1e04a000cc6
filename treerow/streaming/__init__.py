"""Element rows of a stream of pages."""

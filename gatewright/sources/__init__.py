"""Reading corpora and writing result tables."""

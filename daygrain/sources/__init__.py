"""Reading survey files and writing result tables."""

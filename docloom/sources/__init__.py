"""Sources: file listings and text extraction."""

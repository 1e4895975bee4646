"""Classification, exclusive matching, document linking, overlays and quality checks."""

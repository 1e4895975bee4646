"""Reports, exports and the monthly run."""

"""Column to Column functions: text analysis, JSON values, scoring."""

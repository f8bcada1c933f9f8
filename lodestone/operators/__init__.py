"""DataFrame to DataFrame operators: index, search, write log."""

"""What is decided before a DataFrame is built: the order of rules and which of them a change touches."""

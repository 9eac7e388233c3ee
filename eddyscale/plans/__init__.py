"""Parameter types and the dispatcher."""

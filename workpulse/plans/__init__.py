"""The fact adapter and the registry of queries."""

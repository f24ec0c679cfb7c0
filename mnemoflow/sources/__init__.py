"""Table adapters and service connectors."""

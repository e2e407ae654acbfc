"""Connectors: table loading, positional CSV, Kafka-shaped frames (read and write)."""

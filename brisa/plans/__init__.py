"""Query plans over the driver tables: adapters, the batch pipeline, the catalog."""

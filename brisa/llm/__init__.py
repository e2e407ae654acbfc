"""Training-data operators: one module per operator, the dealt queries in ``queries.py``."""

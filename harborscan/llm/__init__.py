"""Training-data operators: one module for each, and ``queries`` which registers them."""

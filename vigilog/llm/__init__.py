"""Training-data operators: one module per operator, all DataFrame to DataFrame."""

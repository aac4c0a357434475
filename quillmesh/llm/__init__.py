"""Training-data operators: one module for each, all independent of the rest of the library."""

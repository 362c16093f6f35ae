"""Training-data operators. Nothing else in docloom imports this subpackage."""

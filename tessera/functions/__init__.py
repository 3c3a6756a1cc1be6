"""Column-expression functions (text, classification) and fixed rule values."""

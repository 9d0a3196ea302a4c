"""Column functions and text encoders."""

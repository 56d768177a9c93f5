"""operators of tilewright."""

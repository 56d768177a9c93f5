"""functions of tilewright."""

"""plans of tilewright."""

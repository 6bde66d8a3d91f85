"""Statistics as DataFrame plans."""

"""Reading and preparing tables."""

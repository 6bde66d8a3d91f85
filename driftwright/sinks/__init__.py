"""Report folders and addresses."""

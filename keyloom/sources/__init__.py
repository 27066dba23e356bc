"""Binary and text data sources."""

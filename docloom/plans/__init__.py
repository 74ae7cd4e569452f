"""Sessions and whole dataflows."""

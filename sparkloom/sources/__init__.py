"""sparkloom.sources."""

"""sparkloom.operators."""

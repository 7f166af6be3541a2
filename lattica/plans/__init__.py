"""The solve loop, fixtures derived from the driver's tables, and the test queries."""

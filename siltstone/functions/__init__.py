"""Column functions shared by the queries."""

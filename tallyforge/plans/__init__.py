"""End-to-end plans: raw to gold tables, and the serving functions."""

"""Query catalogue: what the driver can run, with the SQL that must agree."""

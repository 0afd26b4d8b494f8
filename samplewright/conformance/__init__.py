"""One query per operator over the shared test tables, and SQL that must agree with it."""

"""Named queries over the test tables, and SQL that computes the same."""

"""Named queries: each applies an operator to driver tables, with the SQL that checks it."""

"""Pure Column expressions: no actions, no Python in the row path."""

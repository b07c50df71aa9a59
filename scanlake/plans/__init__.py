"""Named queries over the provided tables, each with its SQL."""

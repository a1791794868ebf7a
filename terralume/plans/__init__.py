"""Named queries, their SQL twins, and the whole detection plan."""

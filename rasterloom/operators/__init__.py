"""Table operators: joins, groupings, windows."""

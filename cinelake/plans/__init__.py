"""Plans: the registered queries, the fragment planner and the lazy array view."""

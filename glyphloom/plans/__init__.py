"""Plan helpers: where work runs and how it is cut."""

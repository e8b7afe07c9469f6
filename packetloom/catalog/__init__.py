"""Every operator as a named query over the given tables, with the equal SQL where SQL can say it."""

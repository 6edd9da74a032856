"""Column functions; Arrow UDFs only where no built-in expression exists."""

"""Column expressions: everything here runs inside the JVM, no Python per row."""

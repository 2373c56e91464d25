"""Column functions: every rule is an expression over columns, evaluated in the JVM."""

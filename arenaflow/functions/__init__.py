"""Column macros: scalar logic as expressions that stay in the JVM."""

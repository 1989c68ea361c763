"""Column-level helpers: pure expressions that stay inside the JVM."""

"""Column expressions; every one stays in the JVM."""

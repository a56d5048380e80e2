"""Column expressions: everything here stays JVM-side (no Python UDFs)."""

"""Column-level building blocks (JVM-side expressions, no Python workers)."""

"""Column-level helpers (JVM-side expressions) and the few small UDFs."""

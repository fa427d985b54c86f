"""Column-returning functions: everything here stays inside JVM expressions."""

"""Column functions: every scalar rule stays inside the JVM."""

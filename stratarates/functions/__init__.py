"""Column expressions; everything stays inside the JVM and whole-stage codegen."""

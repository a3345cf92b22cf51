"""Column functions: text in, values out, all inside the JVM."""

"""Column functions: angles, rotations, optics, names. All stay in the JVM."""

"""Sources and sinks: seeded random matrices, Matrix Market files, arrays."""

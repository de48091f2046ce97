"""Guarded, parameterised, read-only SQL, with Spark as the provider."""

"""Scalar column builders. Everything stays in JVM expressions except Unicode folding and IDNA."""

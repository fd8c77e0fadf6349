"""Readers and writers (S1-S6) and the bindings from the driver's tables."""

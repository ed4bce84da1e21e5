"""Column expressions and pure numpy routines used inside grouped Arrow functions."""

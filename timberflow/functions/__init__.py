"""Column expressions: no actions, no UDFs unless the name says so."""

"""Column expressions: no joins, no shuffles, all inside code generation."""

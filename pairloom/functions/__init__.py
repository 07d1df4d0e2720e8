"""Column expressions: no joins, no shuffles, all inside whole-stage code generation where Spark can."""

"""Column templates of the series operators."""

"""Column expressions: values, codes and geometry."""

"""Column expressions: time codes, names, texts, levels."""

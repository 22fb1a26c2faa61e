"""Column expressions: text, cells of tables, vectors."""

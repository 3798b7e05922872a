"""Column expressions: vocabulary tables, geodesy, kinds, text and sentences."""

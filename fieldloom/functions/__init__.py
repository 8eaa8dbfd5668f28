"""Column expressions: blanks, dates, field kinds, shards and text formats."""

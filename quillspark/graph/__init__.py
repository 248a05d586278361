"""Property graphs as two tables: nodes(id, label, properties) and edges(src, dst, label, weight, properties)."""

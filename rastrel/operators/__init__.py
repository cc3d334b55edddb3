"""Relational operators over cells, graphs, patches, maps and attributions."""

"""Analytics over dependency graphs, source text and change streams, as DataFrame and SQL plans."""

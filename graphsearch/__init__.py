"""graphsearch: search over text corpora with an entity graph, as DataFrame transformations."""

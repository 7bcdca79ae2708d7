"""Named business queries, each a composition of operators."""

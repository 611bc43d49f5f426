"""DataFrame operators: joins, matching, regions, glossary, children, metrics."""

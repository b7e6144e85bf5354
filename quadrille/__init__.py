"""quadrille: graph, rule and semantic queries over ordinary tables, on Spark."""

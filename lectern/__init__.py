"""Document search, record resolution, hierarchy, graph and text analytics as PySpark DataFrame operators."""

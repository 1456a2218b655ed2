"""dossier: evidence, graph and review analytics as PySpark DataFrame operators."""

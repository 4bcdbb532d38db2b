"""vigil: credential hygiene and leak screening as PySpark DataFrame jobs."""

"""notespark: note retrieval and corpus processing on PySpark."""

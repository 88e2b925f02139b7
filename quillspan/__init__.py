"""quillspan: GoogleSQL-style analytics and training-data operators on PySpark."""

"""docloom: document-label analytics and training-data operators on PySpark."""

"""A PySpark engine for document-centred casework."""
